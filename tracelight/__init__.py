"""Forensic analytics over network connection logs and model updates, on Spark."""

from tracelight.session import get_session, shared_directory

__all__ = ["get_session", "shared_directory"]
__version__ = "0.1.0"
