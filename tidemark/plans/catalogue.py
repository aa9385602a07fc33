"""All queries by name and their SQL."""

from __future__ import annotations

from . import chains, more, panel, stores, surfaces, tables, verdicts

QUERIES = {**panel.QUERIES, **tables.QUERIES, **verdicts.QUERIES, **more.QUERIES, **stores.QUERIES, **surfaces.QUERIES, **chains.QUERIES}
SQL = {**panel.SQL, **tables.SQL, **verdicts.SQL, **more.SQL, **stores.SQL, **surfaces.SQL, **chains.SQL}
FLAGSHIP = "placebo_rank_p"
