"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of columns (domain, language, source). At every node it is
shared among the children in proportion to their weights; a child that cannot use its share
(its subtree's tokens times ``max_epochs`` are fewer) gives the rest to its siblings, and only
what the whole family cannot use goes to the parent's siblings: children are filled with the
capacities of their subtrees, top down. Each leaf then takes whole seeded epochs of its
documents and, of the next epoch, the longest prefix of documents (in that epoch's seeded
order) whose tokens fit the rest of its budget.

Scale: texts are read once for counts and once for the output, and never shuffled while the
table of leaves is small enough to broadcast (it is written first, so its size is known;
beyond Spark's threshold it is an ordinary join). A leaf with a third of all rows is not
sorted: its order is cut into hash slices whose token sums are aggregated map-side, and only
the one slice that holds the cut is ordered. Windows over the tree run on sums per node.

Defined results: NULL keys are values of their own; a NULL or blank text has no tokens; a leaf
without tokens is taken once; weights that are NULL, negative or missing count as
``default_weight`` (0 for negative); a node of weight 0 gets nothing; if the whole corpus is
too small every leaf is taken ``max_epochs`` times; rows equal in all columns are taken or
left together, so repeated rows never depend on task order; an empty table gives no rows.
The result has the input's columns and ``epoch``; helper columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
LEVELS = ["domain", "lang", "source"]
MAX_EPOCHS = 4
SEED = 17
SLICE_DIGITS = 3  # 4096 slices of each leaf's order
HASH_DIGITS = 15


def tokens_of(text: Column) -> Column:
    """Words stand for tokens where no count is given."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _order(epoch: Column, doc_id: Column, seed: int) -> Column:
    """The seeded position of a document in an epoch: hex digits, compared as text."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, HASH_DIGITS)


def _null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    on = F.lit(True)
    for a, b in pairs:
        on = on & left[a].eqNullSafe(right[b])
    return on


def budgets(leaves: DataFrame, levels: list[str], total: float | Column, weights: dict[str, dict[str, float]], default_weight: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (levels, tokens) with each leaf's ``budget`` in tokens."""
    rows = leaves.withColumn("given", total if isinstance(total, Column) else F.lit(float(total)))
    rows = rows.withColumn("capacity", (F.col("tokens") * max_epochs).cast("double"))
    for depth, level in enumerate(levels):
        parents, path = levels[:depth], levels[: depth + 1]
        nodes = rows.groupBy(*path).agg(F.sum("capacity").alias("cap"), F.first("given").alias("given"))
        named = weights.get(level, {})
        weight = F.lit(None).cast("double")
        if named:
            table = F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.lit(float(v)))])
            weight = F.when(F.col(level).isNotNull(), F.element_at(table, F.col(level)))
        nodes = nodes.withColumn("w", F.greatest(F.coalesce(weight, F.lit(float(default_weight))), F.lit(0.0)))
        # children by how soon they are full; weightless ones last, with nothing
        fill = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
        family = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
        order = family.orderBy(fill, *[F.col(c) for c in path])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        nodes = nodes.withColumns({
            "used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "open": F.sum("w").over(onward), "fill": fill,
        })
        full = (F.col("w") > 0) & (F.col("fill") * F.col("open") <= F.col("given") - F.col("used"))
        nodes = nodes.withColumn("full", full)
        nodes = nodes.withColumns({
            "spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0.0)),
            "rest": F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(family),
        })
        share = F.when(F.col("full"), F.col("cap")).when(F.col("rest") > 0, F.col("w") * (F.col("given") - F.col("spent")) / F.col("rest")).otherwise(F.lit(0.0))
        nodes = nodes.select(*[F.col(c).alias(f"_{c}") for c in path], share.alias("given"))
        rows = rows.drop("given")
        rows = rows.join(nodes, _null_safe(rows, nodes, [(c, f"_{c}") for c in path])).drop(*[f"_{c}" for c in path])
    return rows.select(*levels, "tokens", F.floor(F.col("given") + 1e-6).alias("budget"))


def mix(
    docs: DataFrame, levels: dict[str, Column], total: float | None = None, share: float = 1.0,
    weights: dict[str, dict[str, float]] | None = None, tokens: Column | None = None, text: str = "text", doc_id: str = "doc_id",
    default_weight: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """Documents taken, once per ``epoch``. ``levels`` names the tree's columns, root first.

    The budget is ``total`` tokens, or ``share`` of the corpus's tokens.
    """
    names = list(levels)
    keys = [f"_k{i}" for i in range(len(names))]
    columns = [c for c in docs.columns if c != "epoch"]
    tokens = tokens_of(F.col(text)) if tokens is None else tokens
    numbers = {**{k: levels[n] for k, n in zip(keys, names)}, "_tokens": tokens, "_id": F.col(doc_id), "_row": F.lpad(F.hex(F.xxhash64(*columns)), 16, "0")}
    narrow = written(docs.select(*[v.alias(k) for k, v in numbers.items()]), "token-counts")

    leaves = narrow.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"))
    if total is None:
        total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * float(share)
    plan = budgets(leaves, keys, float(total), dict(zip(keys, [(weights or {}).get(n, {}) for n in names])), default_weight, max_epochs)
    full = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs))).otherwise(F.lit(1))
    plan = plan.withColumn("full", full.cast("int")).withColumn("rest", F.when(F.col("full") < max_epochs, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(F.lit(0)).cast("long"))
    plan = written(plan.select(*[F.col(k).alias(f"p{k}") for k in keys], "tokens", "budget", "full", "rest"), "budgets")
    same = [(k, f"p{k}") for k in keys]

    # the slice of the next epoch's order in which the budget ends
    placed = narrow.join(plan.where("rest > 0"), _null_safe(narrow, plan, same))
    placed = placed.withColumn("h", _order(F.col("full") + 1, F.col("_id"), seed)).withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
    sums = placed.groupBy(*keys, "slice", "rest").agg(F.sum("_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("slice"))
    cut = sums.withColumn("upto", upto).where("upto > rest AND upto - n <= rest")
    cut = cut.groupBy(*[F.col(k).alias(f"c{k}") for k in keys]).agg(F.min("slice").alias("c_slice"), F.min_by(F.col("upto") - F.col("n"), F.col("slice")).alias("c_before"))
    at_cut = placed.join(cut, _null_safe(placed, cut, [(k, f"c{k}") for k in keys]) & (placed["slice"] == cut["c_slice"]))
    # one id may fill the slice: its rows are cut by the first digits of their own hash, then by the rest; equal rows are one
    salt = F.substring("_row", 1, SLICE_DIGITS).alias("salt")
    salted = at_cut.groupBy(*keys, "h", salt, "rest", "c_before").agg(F.sum("_tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("h", "salt")) + F.col("c_before")
    salted = written(salted.withColumn("running", running), "cut-salts")
    whole = salted.where("running <= rest").groupBy(*keys).agg(F.max(F.struct("h", F.concat("salt", F.lit("~")).alias("_row"))).alias("last"))
    edge = salted.where("running > rest AND running - n <= rest").select(*[F.col(k).alias(f"e{k}") for k in keys], F.col("h").alias("e_h"), F.col("salt").alias("e_salt"), (F.col("running") - F.col("n")).alias("e_before"))
    edge = edge.groupBy(*[f"e{k}" for k in keys]).agg(F.min(F.struct("e_h", "e_salt", "e_before")).alias("e")).select(*[f"e{k}" for k in keys], "e.*")
    tail = at_cut.join(edge, _null_safe(at_cut, edge, [(k, f"e{k}") for k in keys]) & (at_cut["h"] == edge["e_h"]) & (F.substring(at_cut["_row"], 1, SLICE_DIGITS) == edge["e_salt"]))
    tail = tail.groupBy(*keys, "h", "_row", "rest", "e_before").agg(F.sum("_tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("_row")) + F.col("e_before")
    tail = tail.withColumn("running", running).where("running <= rest").groupBy(*keys).agg(F.max(F.struct("h", "_row")).alias("last"))
    last = whole.unionByName(tail).groupBy(*[F.col(k).alias(f"l{k}") for k in keys]).agg(F.max("last").alias("last"))
    ends = plan.join(cut, _null_safe(plan, cut, [(f"p{k}", f"c{k}") for k in keys]), "left")
    ends = ends.join(last, _null_safe(ends, last, [(f"p{k}", f"l{k}") for k in keys]), "left")
    ends = written(ends.select(*[f"p{k}" for k in keys], "full", "rest", "c_slice", F.col("last.h").alias("l_h"), F.col("last._row").alias("l_row")), "leaf-cuts")

    rows = docs.select(F.struct(*columns).alias("_doc"), numbers["_id"].alias("_id"), *[numbers[k].alias(k) for k in keys], numbers["_row"].alias("_row"))
    rows = rows.join(ends, _null_safe(rows, ends, same))
    h = _order(F.col("full") + 1, F.col("_id"), seed)
    before = F.substring(h, 1, SLICE_DIGITS) < F.col("c_slice")
    inside = (F.substring(h, 1, SLICE_DIGITS) == F.col("c_slice")) & ((h < F.col("l_h")) | ((h == F.col("l_h")) & (F.col("_row") <= F.col("l_row"))))
    taken = (F.col("rest") > 0) & (F.col("c_slice").isNull() | before | F.coalesce(inside, F.lit(False)))
    epochs = F.concat(F.sequence(F.lit(1), F.col("full")), F.when(taken, F.array(F.col("full") + 1)).otherwise(F.array().cast("array<int>")))
    epochs = F.when(F.col("full") > 0, epochs).otherwise(F.when(taken, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return rows.select("_doc.*", F.explode(epochs).alias("epoch"))


def document_levels() -> dict[str, Column]:
    """The tree used for the table of documents: its sources' number modulo four stands for the domain."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"([0-9]{1,9})$", 1)
    return {"domain": F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), F.pmod(number.cast("long"), F.lit(4)).cast("string"))), "lang": F.col("lang"), "source": F.col("source")}


# Target weights of the registered query and the pipeline; nodes not named here weigh 1.
WEIGHTS = {"domain": {"domain0": 3.0, "domain1": 2.0, "domain2": 2.0, "domain3": 2.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}}
