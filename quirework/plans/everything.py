"""Imports every module of queries, so that the registry is whole."""

from quirework.plans import documents, layout, library, licences, lifecycle, markup, rules, streams, telemetry  # noqa: F401
from quirework.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
