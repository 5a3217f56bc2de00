"""All queries of the library and their SQL, collected from the job modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

JOBS: dict[str, Callable] = {}
SQL: dict[str, str] = {}
MODULES = ("log_jobs", "projection_jobs", "inbox_jobs", "queue_jobs", "pool_jobs", "dag_jobs", "fanout_jobs", "telemetry_jobs", "store_jobs", "stream_jobs")


def job(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        JOBS[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict:
    for m in MODULES:
        importlib.import_module(f"wflog.jobs.{m}")
    return dict(JOBS)


def oracle_sql() -> dict:
    queries()
    return dict(SQL)
