"""quizspark streaming."""
