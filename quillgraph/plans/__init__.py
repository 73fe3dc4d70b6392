"""Registered queries, each beside the SQL for its rows."""

from . import registry  # noqa: F401  loads all modules in one order, whichever of them is asked for first
