"""All queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pulsegrid.plans import curation, identity, models, recordings, records, trains, trials  # noqa: F401  register their queries
from pulsegrid.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
