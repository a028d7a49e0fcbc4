"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans import ingest, serve

QUERIES = ingest.QUERIES | serve.QUERIES
SQL = ingest.SQL | serve.SQL
