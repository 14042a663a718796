"""Catalogue of the runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


# Role views shared by the SQL counterparts.
SIG = """sig AS (
  SELECT event_id, ts, user_id, event_type, value AS v,
         CASE WHEN event_type = 'error' THEN NULL ELSE value END AS vm,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx
  FROM events)"""
WIN = SIG + """,
len AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id),
win AS (
  SELECT s.*, w.w FROM sig s JOIN len USING (user_id), LATERAL (
    SELECT unnest([s.idx // 10 - 1, s.idx // 10]) AS w) w
  WHERE w.w >= 0 AND w.w * 10 + 20 <= len.total)"""
SCORED = """scored AS (
  SELECT l.doc_id, d.lang, d.source, l.quality AS y, l.toxic,
         (d.n_chars % 1000) / 1000.0::DOUBLE AS p,
         CASE WHEN (d.n_chars % 1000) / 1000.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS yhat
  FROM labels l JOIN documents d USING (doc_id))"""
EMB = """emb AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"""


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
