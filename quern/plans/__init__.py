"""The SQL surface: dialect, table store and engine."""

from quern.plans.engine import Engine, Prepared, UnsupportedStatement

__all__ = ["Engine", "Prepared", "UnsupportedStatement"]
