"""All queries of the library but those on texts, by name, and their SQL where there is one."""

from __future__ import annotations

from tidemark.plans import ingestion, ingestion_sql, panel, panel_sql

FLAGSHIP = "cohort_bets"
QUERIES = {**panel.QUERIES, **ingestion.QUERIES}
ORACLE_SQL: dict[str, str] = {**panel_sql.SQL, **ingestion_sql.SQL}
