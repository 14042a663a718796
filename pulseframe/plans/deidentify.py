"""De-identification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe import constants as C
from pulseframe.functions import privacy as P
from pulseframe.operators import privacy as ops
from pulseframe.plans.registry import query
from pulseframe.plans.roles import r
from pulseframe.sources.tables import table

SALT = "fixture-salt"  # test salt; deployments configure their own


def _pseudonym_sql(expr: str) -> str:
    inner, outer = (p.hex() for p in P._pads(SALT))
    return (f"'PID-' || upper(substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || "
            f"encode(trim(({expr})::VARCHAR))))), 1, 16))")


def _hours_sql(pid: str) -> str:
    return f"(('0x' || substr(sha256({pid}), 1, 8))::BIGINT % 1440 - 720)"


def scrub_sql(expr: str) -> str:
    for _, pattern, tag in C.SCRUB_PATTERNS:
        expr = f"regexp_replace({expr}, '{pattern}', '{tag}', 'g')"
    return expr


@query("pseudonymize_customers", f"SELECT c_custkey, {_pseudonym_sql('c_custkey')} AS pseudonym FROM customer")
def pseudonymize_customers(spark, folder):
    return table(spark, folder, "customer", "c_custkey").select("c_custkey", P.pseudonym(F.col("c_custkey"), SALT).alias("pseudonym"))


@query("jitter_offsets", f"""WITH p AS (SELECT c_custkey, {_pseudonym_sql('c_custkey')} AS pid FROM customer)
SELECT c_custkey, {_hours_sql('pid')} AS hours FROM p""")
def jitter_offsets(spark, folder):
    pid = P.pseudonym(F.col("c_custkey"), SALT)
    return table(spark, folder, "customer", "c_custkey").select("c_custkey", P.jitter_hours(pid).alias("hours"))


@query("jitter_orders", f"""WITH p AS (SELECT o_orderkey, o_orderdate, {_pseudonym_sql('o_custkey')} AS pid FROM orders)
SELECT o_orderkey, pid AS pseudonym, strftime(o_orderdate + INTERVAL 1 HOUR * {_hours_sql('pid')}, '%Y-%m-%d %H:%M:%S') AS shifted FROM p""")
def jitter_orders(spark, folder):
    df = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    df = df.withColumn("pseudonym", P.pseudonym(F.col("o_custkey"), SALT))
    shifted = P.shift_timestamp(F.col("o_orderdate"), F.col("pseudonym"))
    return df.select("o_orderkey", "pseudonym", F.date_format(shifted, "yyyy-MM-dd HH:mm:ss").alias("shifted"))


@query("scrub_documents", f"SELECT doc_id, {scrub_sql('text')} AS text FROM documents")
def scrub_documents(spark, folder):
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", P.scrub(F.col("text")).alias("text"))


_ARRAY_LOG_SQL = "text || ' [' || array_to_string(list_transform(range(1, 7), lambda i: (conv_id % 50 + i) || '.' || (turn % 10)), ', ') || ']'"


@query("scrub_logs", f"""SELECT conv_id, turn, regexp_replace({scrub_sql(_ARRAY_LOG_SQL)},
  '{C.RAW_ARRAY_PATTERN}', '{C.RAW_ARRAY_TAG}', 'g') AS msg FROM conversations""")
def scrub_logs(spark, folder):
    df = table(spark, folder, "conversations", "conv_id", "turn", "text")
    numbers = F.transform(
        F.sequence(F.lit(1), F.lit(6)),
        lambda i: F.concat((F.col("conv_id") % 50 + i).cast("string"), F.lit("."), (F.col("turn") % 10).cast("string")),
    )
    msg = F.concat(F.col("text"), F.lit(" ["), F.concat_ws(", ", numbers), F.lit("]"))
    return df.select("conv_id", "turn", P.scrub_log(msg).alias("msg"))


def _audit_sql() -> str:
    parts = [
        f"SELECT '{n}' AS pattern, count(*) FILTER (regexp_matches(raw, '{p}')) AS before, "
        f"count(*) FILTER (regexp_matches(clean, '{p}')) AS after FROM s" for n, p, _ in C.SCRUB_PATTERNS
    ]
    return f"WITH s AS (SELECT text AS raw, {scrub_sql('text')} AS clean FROM documents) " + " UNION ALL ".join(parts)


@query("phi_audit", _audit_sql())
def phi_audit(spark, folder):
    return ops.phi_audit(table(spark, folder, "documents", "text"), "text")


@query("sanitize_table", f"""
WITH m AS (SELECT *, {_pseudonym_sql('c_custkey')} AS pid FROM customer)
SELECT pid AS patient_pseudonym, pid AS patient_id_pseudonym, {_pseudonym_sql('c_nationkey')} AS region_id_pseudonym,
  {scrub_sql("'Patient Smith, segment ' || c_mktsegment || ', call 555-123-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')")} AS note,
  c_acctbal AS acctbal, c_nationkey AS lead_id,
  strftime(TIMESTAMP '2026-05-15 10:30:00' + INTERVAL 1 HOUR * {_hours_sql('pid')}, '%Y-%m-%d %H:%M:%S') AS visit
FROM m""")
def sanitize_table(spark, folder):
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("patient_name"), F.col("c_nationkey").alias("region_id"),
        F.concat(F.lit("Patient Smith, segment "), F.col("c_mktsegment"), F.lit(", call 555-123-"),
                 F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")).alias("note"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("lead_id"),
        F.lit("2026-05-15 10:30:00").cast("timestamp").alias("visit"),
    )
    return ops.sanitize(raw, SALT).withColumn("visit", F.date_format("visit", "yyyy-MM-dd HH:mm:ss"))


@query("sanitize_metadata", f"""
SELECT c_custkey, {_pseudonym_sql('c_custkey')} AS subject_id_pseudonym, {scrub_sql("'seen by dr. ' || lower(c_mktsegment)")} AS note,
  3 AS n_keys FROM customer""")
def sanitize_metadata(spark, folder):
    meta = F.create_map(
        F.lit("subject_id"), F.col("c_custkey").cast("string"), F.lit("Doctor"), F.lit("Dr. Who"),
        F.lit("note"), F.concat(F.lit("seen by dr. "), F.lower("c_mktsegment")), F.lit("lead_id"), F.lit("V5"),
    )
    df = table(spark, folder, "customer", "c_custkey", "c_mktsegment").select("c_custkey", ops.sanitize_map(meta, SALT).alias("m"))
    return df.select("c_custkey", F.col("m")["subject_id_pseudonym"].alias("subject_id_pseudonym"), F.col("m")["note"].alias("note"),
                     F.size("m").alias("n_keys"))
