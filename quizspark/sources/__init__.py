"""quizspark sources."""
