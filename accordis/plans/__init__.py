"""Registered queries, by area."""

from . import analysis, discovery, graphs, histories, reconciliation, reports, scoring, stores, texts, ticketing, windows
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analysis", "discovery", "graphs", "histories", "reconciliation", "reports", "scoring", "stores", "texts", "ticketing", "windows"]
