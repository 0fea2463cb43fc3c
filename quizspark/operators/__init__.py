"""quizspark operators."""
