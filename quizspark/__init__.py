"""quizspark: Spark-native scoring, difficulty, curriculum ordering and
evaluation of multiple-choice question (MCQ) data.

Everything is DataFrame / SQL / MLlib code; Python only appears as small
per-row helpers on tiny result tables (p-values) and as the pluggable
encoder hook for text embeddings.
"""

from quizspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
