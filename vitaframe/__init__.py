"""vitaframe: résumé document analytics written as Spark DataFrame jobs."""

from vitaframe.session import build_session

__all__ = ["build_session"]
