"""The library's operators bound to the given tables, each with SQL to check it."""

from bindings.registry import CHECKS, QUERIES, bound
from bindings import ledger_queries, drift_queries, inventory_queries  # noqa: F401, I001  (shared check views come first)
