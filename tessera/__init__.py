"""tessera: corpus retrieval, language-model scoring and lossless compression as Spark jobs."""

from tessera.session import get_session, table, checkpoint_dir

__all__ = ["get_session", "table", "checkpoint_dir"]
