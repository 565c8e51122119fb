"""Every query of the engine bound to the given tables, each beside the SQL that states its result."""

from .catalog import QUERIES, load_all

__all__ = ["QUERIES", "load_all"]
