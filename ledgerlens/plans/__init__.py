"""Registered queries and their DuckDB SQL."""

from . import alerts, arrivals, connections, evidence, graphs, planning, scalars, texts, views
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "alerts", "arrivals", "connections", "evidence", "graphs", "planning", "scalars", "texts", "views"]
