"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import auditing, files, ingestion, reporting, streaming

QUERIES: dict = {**files.QUERIES, **ingestion.QUERIES, **reporting.QUERIES, **auditing.QUERIES, **streaming.QUERIES}
ORACLES: dict = {**files.ORACLES, **ingestion.ORACLES, **reporting.ORACLES, **auditing.ORACLES, **streaming.ORACLES}
