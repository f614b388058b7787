"""Importing this module registers every query."""

from queries import (  # noqa: F401
    facets,
    geo,
    lake,
    matching,
    pages,
    payloads,
    privacy,
    quality,
    records,
    search,
    storage,
    streams,
    texts,
)
from queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
