"""The jobs as queries, and their DuckDB oracles."""

from __future__ import annotations

from .brick_demand import JOB1_SQL, job1_brick_demand
from .corpus_volume import JOB2_SQL, job2_corpus_volume

QUERIES = {"job1_brick_demand": job1_brick_demand, "job2_corpus_volume": job2_corpus_volume}
ORACLES = {"job1_brick_demand": JOB1_SQL, "job2_corpus_volume": JOB2_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
