"""quizspark plans."""
