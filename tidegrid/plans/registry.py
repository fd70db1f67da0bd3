"""All registered queries and their DuckDB twins, by name."""

from __future__ import annotations

from . import annotations, audits, cohorts, evidence, geometry, grids, records, screening, selections
from .catalogue import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "annotations", "audits", "cohorts", "evidence", "geometry", "grids", "records", "screening", "selections"]
