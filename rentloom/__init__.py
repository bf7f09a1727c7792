"""Property analytics for whole portfolios, written as PySpark DataFrame jobs."""

from rentloom.session import get_session

__all__ = ["get_session"]
