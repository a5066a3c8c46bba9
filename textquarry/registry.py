"""name -> query and name -> SQL that gives the same rows."""

from __future__ import annotations

from .plans import history, reports, stored, streams, tables, tree

QUERIES: dict = tables.QUERIES | history.QUERIES | streams.QUERIES | tree.QUERIES | reports.QUERIES | stored.QUERIES
ORACLES: dict[str, str] = tables.ORACLES | history.ORACLES | streams.ORACLES | tree.ORACLES | reports.ORACLES | stored.ORACLES
