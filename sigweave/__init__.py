"""Web technology detection over page captures, as Spark jobs."""

from sigweave.session import get_session

__all__ = ["get_session"]
