"""Registered queries; importing this package fills the registry."""

from mnemospark.plans import graph, jobs, retrieval, scopes, sources, storage, streams, texts, writes
from mnemospark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph", "jobs", "retrieval", "scopes", "sources", "storage", "streams", "texts", "writes"]
