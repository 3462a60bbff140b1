"""Early-warning analytics over system-log streams, written as Spark jobs."""

from omenlog.session import checkpointed, get_spark, shared_folder

__all__ = ["checkpointed", "get_spark", "shared_folder"]
