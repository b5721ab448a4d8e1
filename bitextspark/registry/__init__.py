"""Registered queries over the given tables, each with its SQL counterpart."""

from bitextspark.registry.base import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
