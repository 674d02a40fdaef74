"""Constraint-first similarity search over large catalogs, as PySpark jobs."""

from sieverank.session import get_session, shared_folder

__all__ = ["get_session", "shared_folder"]
