"""Checked queries over the test tables."""

from importlib import import_module

MODULES = ("tables", "objectives", "operations", "streams")


def load_all():
    """(queries, oracle SQL) by name."""
    for m in MODULES:
        import_module(f"suite.{m}")
    base = import_module("suite.base")
    return dict(base.QUERIES), dict(base.ORACLES)
