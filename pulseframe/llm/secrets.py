"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds,
per blob, the rule versions that have scanned it and what each version found; a run scans only
the (blob, rule version) pairs the ledger does not have and joins the findings of the versions
asked for back to all paths that ever held the blob, so a changed rule replaces its findings. All work is built-in expressions: a pattern's matches come
from ``regexp_extract_all``, the gaps between them from ``split`` with the same pattern, and
running sums of both lengths give the positions.

Scale: copies collapse before they are scanned (map-side combine on the blob address, so a
blob that fills a third of the table leaves each map task once); the texts are shuffled once;
positions are summed inside one blob. The join of findings to paths carries no text, and AQE
may split its path side. The ledger is a Parquet folder; each run appends to it.

Defined results: NULL content is the empty text; a text without matches has an empty span
list; repeated rows and equal contents get equal findings; positions are code points, ends
exclusive; an empty table gives no rows; other columns of the input pass through unless a
result has their name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pulseframe.session import scratch

# The pattern of each kind, in the order in which kinds sort.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 and more; shorter runs hold no other match
HEX = r"[0-9a-f]{24,}"
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
JSON_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
HOST_TOKEN = r"gh[pousr]_[A-Za-z0-9]{36,}"
CHAT_TOKEN = r"xox[abprs]-[A-Za-z0-9-]{10,}"
CLOUD_KEY = r"AIza[A-Za-z0-9_-]{35}"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    version: int = 1
    group: int = 0  # the part that must be at least ``shortest`` long
    shortest: int = 1
    literal: str = ""  # every match contains it: a cheap test before the pattern

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = [Rule("assign", ASSIGN, group=2, shortest=6), Rule("access", ACCESS, literal="AKIA"), Rule("hex", HEX)]
RULES = [
    *BASE,
    Rule("private_key", PRIVATE_KEY, literal="PRIVATE KEY-----"),
    Rule("json_token", JSON_TOKEN, literal="eyJ"),
    Rule("host_token", HOST_TOKEN, literal="gh"),
    Rule("chat_token", CHAT_TOKEN, literal="xox"),
    Rule("cloud_key", CLOUD_KEY, literal="AIza"),
]
FOUND = "array<struct<kind:string,gap:int,size:int,ok:boolean,k:int>>"
FINDING = "struct<start:bigint,rank:int,end:bigint,kind:string,version:int>"
LEDGER = f"blob_id string, rule_keys array<string>, findings array<{FINDING}>"


def _matches(text: Column, rule: Rule) -> Column:
    """Per match its kind, the length of the gap before it, its own length, its validity and number."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    pairs = F.zip_with(
        F.split(text, rule.pattern, -1), hits,
        lambda gap, hit: F.struct(
            F.lit(rule.kind).alias("kind"), F.length(gap).alias("gap"), F.length(hit).alias("size"),
            (F.length(F.regexp_extract(hit, rule.pattern, rule.group)) >= rule.shortest if rule.group else F.lit(True)).alias("ok"),
        ),
    )
    numbered = F.transform(F.filter(pairs, lambda p: p["size"].isNotNull()), lambda p, k: F.struct(p["kind"].alias("kind"), p["gap"].alias("gap"), p["size"].alias("size"), p["ok"].alias("ok"), k.alias("k")))
    maybe = F.rlike(text, F.lit(rule.pattern))
    if rule.literal:
        maybe = F.contains(text, F.lit(rule.literal)) & maybe
    return F.when(maybe, numbered).otherwise(F.array().cast(FOUND))


def blobs(versions: DataFrame, text: str) -> DataFrame:
    """One row per distinct content."""
    content = F.coalesce(F.col(text), F.lit(""))
    return versions.select(F.sha2(content, 256).alias("blob_id"), content.alias("content")).groupBy("blob_id").agg(F.first("content").alias("content"))


def scan(unseen: DataFrame, rules: list[Rule], seen: str | None = None) -> DataFrame:
    """Ledger rows of blobs; ``seen`` names an array column of rule keys that need no scan."""
    def wanted(rule: Rule) -> Column:
        found = _matches(F.col("content"), rule)
        return F.when(~F.array_contains(seen, rule.key), found).otherwise(F.array().cast(FOUND)) if seen else found

    keys = F.array(*[F.lit(r.key) for r in rules])
    done = F.array_except(keys, F.col(seen)) if seen else keys
    hits = unseen.select("blob_id", done.alias("rule_keys"), F.explode_outer(F.concat(*[wanted(r) for r in rules])).alias("m"))
    order = Window.partitionBy("blob_id", "m.kind").orderBy("m.k")
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(order)
    of_kind = lambda values: F.create_map(*[x for r, v in zip(rules, values) for x in (F.lit(r.kind), F.lit(v))])[F.col("m.kind")]
    rank, version = of_kind(range(len(rules))), of_kind([r.version for r in rules])
    placed = hits.select("blob_id", "rule_keys", "m", end.alias("end"))
    finding = F.when(F.col("m.ok"), F.struct(
        (F.col("end") - F.col("m.size")).alias("start"), rank.alias("rank"), F.col("end"), F.col("m.kind").alias("kind"), version.alias("version"),
    ))
    return placed.groupBy("blob_id").agg(F.first("rule_keys").alias("rule_keys"), F.collect_list(finding).alias("findings"))


def _open(spark, ledger: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def update(versions: DataFrame, ledger: str, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger`` lacks, append it, and return the whole ledger."""
    spark = versions.sparkSession
    found = blobs(versions, text)
    old = _open(spark, ledger)
    if old is None:
        new = scan(found, rules)
    else:
        keys = F.array(*[F.lit(r.key) for r in rules])
        seen = old.select("blob_id", F.explode("rule_keys").alias("key")).groupBy("blob_id").agg(F.collect_set("key").alias("seen"))
        todo = found.join(seen, "blob_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        new = scan(todo.where(F.size(F.array_except(keys, F.col("seen"))) > 0), rules, "seen")
    new.write.mode("append").parquet(ledger)
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(versions: DataFrame, text: str = "text", rules: list[Rule] = RULES, ledger: str | None = None) -> DataFrame:
    """``versions`` without their text, each with ``blob_id`` and its sorted ``findings`` under ``rules``."""
    ledger = ledger or scratch(versions.sparkSession, "ledger")
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("a kind may have one rule")
    whole = update(versions, ledger, text, rules)
    asked = {r.kind: (i, r.version) for i, r in enumerate(rules)}
    rank = F.create_map(*[x for kind, (i, _) in asked.items() for x in (F.lit(kind), F.lit(i))])
    ours = F.lit(False)
    for kind, (_, version) in asked.items():
        ours = ours | ((F.col("f.kind") == kind) & (F.col("f.version") == version))
    found = whole.select("blob_id", F.explode("findings").alias("f")).where(ours)
    # as a set: two runs at the same time may both have scanned a blob; ranks are those of the rules asked for now
    found = found.select("blob_id", F.struct("f.start", rank[F.col("f.kind")].alias("rank"), "f.end", "f.kind", "f.version").alias("f"))
    per_blob = found.groupBy("blob_id").agg(F.sort_array(F.collect_set("f")).alias("findings"))
    kept = [c for c in versions.columns if c not in (text, "blob_id", "findings")]
    paths = versions.select(*kept, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob_id"))
    return paths.join(per_blob, "blob_id", "left").select(*kept, "blob_id", F.coalesce("findings", F.array().cast(f"array<{FINDING}>")).alias("findings"))


def joined(found: Column) -> Column:
    """``kind:start:end`` of every finding, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
