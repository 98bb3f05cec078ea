"""Registered queries over the given tables, each with the SQL that must agree."""

from sparkwave.suite.registry import load

__all__ = ["load"]
