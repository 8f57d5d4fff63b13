"""Every query over the documentation tables, with its DuckDB SQL."""

from __future__ import annotations

from folio.plans import page_queries, report_queries, url_queries

QUERIES: dict = {**url_queries.QUERIES, **page_queries.QUERIES, **report_queries.QUERIES}
ORACLE: dict = {**url_queries.ORACLE, **page_queries.ORACLE, **report_queries.ORACLE}
FLAGSHIP = "page_outcomes"
