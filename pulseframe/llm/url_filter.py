"""URL allow and block rules matched by hashed host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits its host and every subdomain when the url's path
starts with the rule's path; of several fitting rules the longest decides (host + path, then
the longer host, then block before allow). A rule is filed under the expression
``host + path up to its last slash``. Each url emits the expressions that some rule could be
filed under: its host's last k labels and its path's first d segments for the (k, d) shapes
the rules have, so work per url depends on the rules' shapes, not on the url's length. The
expressions meet the rules in an equi-join on eight hex digits of their SHA-256; the full
digest and the rest of the rule's path are confirmed after it.

Scale: urls are first reduced to distinct (host, path) pairs with map-side combine, so a url
that fills a third of the table is judged once. The verdicts are joined back on the pair as a
left join whose large side AQE may split. The rule table's own size decides whether it is
broadcast. Nothing is collected but the distinct rule shapes (at most labels x segments).

Defined results: NULL urls and urls without ``://`` have empty host and path; a url that no
rule fits has a NULL rule and the default verdict; repeated rows are judged alike; NULL hosts
or paths in rules count as empty, rules repeated with both verdicts block; an empty rule
table gives the default everywhere; an empty table gives no rows. Columns named like a
result are replaced, all others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import lower_ascii

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules with their shape (labels, slashes) and the digest of the expression they are filed under."""
    host, path = lower_ascii(F.coalesce(F.col("host"), F.lit(""))), F.coalesce(F.col("path"), F.lit(""))
    slashes = _count(path, "/")
    rest = F.substring_index(path, "/", -1)  # what follows the last slash
    filed = F.when(slashes > 0, F.substring(path, F.lit(1), F.length(path) - F.length(rest))).otherwise("")
    digest = F.sha2(F.concat(host, F.lit("\n"), filed), 256)
    return rules.select(
        host.alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict"),
        (_count(host, ".") + 1).alias("r_labels"), slashes.alias("r_slashes"), digest.alias("r_digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("r_prefix"),
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    spark = pages.sparkSession
    filed = rule_table(rules)
    shapes = [(r[0], r[1]) for r in filed.select("r_labels", "r_slashes").distinct().sort("r_labels", "r_slashes").collect()]
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*kept).alias("page"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not shapes:
        return rows.select("page.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels, slashes = _count(F.col("host"), ".") + 1, _count(F.col("path"), "/")
    emitted = [
        F.when((labels >= k) & (slashes >= d), F.concat(
            F.substring_index("host", ".", -k), F.lit("\n"),
            F.concat(F.substring_index("path", "/", d), F.lit("/")) if d else F.lit(""),
        ))
        for k, d in shapes
    ]
    distinct = rows.select("host", "path").distinct()
    digests = distinct.select("host", "path", F.explode(F.array(*emitted)).alias("e")).where("e IS NOT NULL")
    digests = digests.withColumn("digest", F.sha2("e", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    hits = digests.join(filed, F.col("prefix") == F.col("r_prefix"))
    hits = hits.where((F.col("digest") == F.col("r_digest")) & F.startswith("path", "r_path"))
    best = F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
        (F.col("r_verdict") == "block").alias("blocks"),
        F.concat("r_host", F.when(F.startswith("r_path", F.lit("/")), F.col("r_path")).otherwise(F.concat(F.lit("/"), "r_path"))).alias("rule"),
        F.col("r_verdict").alias("verdict"),
    ))
    decided = hits.groupBy("host", "path").agg(best.alias("best"))
    out = rows.join(decided, ["host", "path"], "left")
    return out.select(
        "page.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def default_rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")
