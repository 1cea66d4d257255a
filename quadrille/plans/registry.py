"""All registered queries with their SQL; each module of this folder adds its own."""

from __future__ import annotations

from quadrille.plans import blocks, distances, estimators, intervals, joins, metrics, models, raster, records, scalar, sources, variance  # noqa: F401
from quadrille.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
