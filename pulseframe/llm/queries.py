"""The registered queries of this package and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.functions.binding import let
from pulseframe.llm import (
    ann, language_model, licenses, line_dedup, merkle, mixing, packing, periodic, quality, secrets, simhash, token_counts, url_filter,
)
from pulseframe.llm.common import read, words_of
from pulseframe.llm.sql import ORACLES  # noqa: F401


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    judged = url_filter.judge(pages, url_filter.default_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), size=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.findings(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.joined(F.filter("findings", lambda f: f["kind"].isin(base))), 256).alias("base_sha256"),
        secrets.joined(F.col("findings")).alias("spans"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    places = F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["first"].cast("string"), r["size"].cast("string"))), ",")
    return done.select("doc_id", "text", "removed_lines", "removed_words", places.alias("removed"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    docs = docs.select("doc_id", "lang", "source", mixing.document_levels()["domain"].alias("domain"), mixing.tokens_of(F.col("text")).alias("n_tokens"))
    levels = {n: F.col(n) for n in mixing.LEVELS}
    taken = mixing.mix(docs, levels, weights=mixing.WEIGHTS, tokens=F.col("n_tokens"))
    return taken.select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack(read(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    rules = quality.learn(quality.labelled(docs, read(spark, sf_dir, "labels")))
    return quality.judge(docs, rules).select("doc_id", *quality.STATS, "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    return token_counts.section_tokens(docs, ["lang", "source"], rule="most")


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    found = licenses.scan(docs, licenses.document_path(), licenses.template_table(spark))
    return found.select("doc_id", "path", "license", "cosine", "scope", "origin")


def _id_crc() -> Column:
    return F.crc32(F.col("doc_id").cast("string"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(_id_crc() % 7 == 2, F.lit(False)))
    model = language_model.fit(docs.where(~F.col("held_out")))
    scored = language_model.score(docs, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _with_period(text: Column) -> Column:
    """In a tenth of the documents all words from one place on repeat a stretch."""
    g = F.floor(_id_crc() / 10)

    def planted(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(w, lambda _, i: F.get(w, place(i))), " ")).otherwise("")

    return F.when(_id_crc() % 10 == 0, let(words_of(text), planted)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = periodic.periodic_runs(docs.select("doc_id", _with_period(F.col("text")).alias("text")))
    run = lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))
    longer = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(longer(a, r), r).otherwise(a))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", run), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars"]
    docs = read(spark, sf_dir, "documents", *columns, "text")
    tampered = F.when(F.coalesce(_id_crc() % 2 == 0, F.lit(False)), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = docs.select("doc_id", "source", merkle.leaf_of(*columns, "text").alias("now"), merkle.leaf_of(*columns, tampered).alias("tampered"))
    proved = merkle.manifest(rows, F.col("now"), "source", "doc_id")
    folded = proved.withColumn("folded_root", merkle.fold(F.col("tampered"), F.col("proof")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_simhash, op3_secret_scans, op4_line_dedup, op5_mixing, op6_packing, op7_nearest_neighbours,
        op8_quality_rules, op9_token_counts, op10_license_scans, op11_language_model, op12_periodic_runs, op13_merkle_manifest,
    )
}
