"""Quality rules: text statistics and a learned decision list over them.

Statistics are built-in expressions over the whole text. The decision list is learned from
labelled statistics by sequential covering: a rule is a conjunction of threshold conditions,
grown on two thirds of the labelled rows by FOIL gain, pruned from its end on the other third,
and kept if it is precise enough there; the rows it covers are removed and the next rule is
grown. The list becomes one ordered conditional expression (first fitting rule decides), so
applying it is part of the same scan as the statistics.

Scale: no shuffle of texts at all. Labels are taken for a sample of at most ``SAMPLE_ROWS``
labelled ids, in hash order; this bounded set is broadcast to the documents and its statistics
(a few numbers a row) are what the learner reads. Rules apply to every row.

Defined results: NULL texts have no words; a text without words fails the base rule; repeated
rows are judged alike; labels that are NULL or not 0/1 are left out, an id with several labels
counts with each; with no labels, or no precise rule, the list is empty and only the base rule
rejects; an empty table gives no rows; results replace columns of their name, all others pass.
Three-word windows are compared by 64-bit hashes (chance of a false repeat in a text of 20 000
words: 1e-11).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.functions.binding import let
from pulseframe.llm.common import words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent
SAMPLE_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 48
MIN_PRECISION = 0.95
MIN_COVER = 5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MARKS = "!?"
FEATURES = {
    "n_words": lambda c: c("n_words"),
    "word_length": lambda c: c("word_chars") / F.greatest(c("n_words"), F.lit(1)),
    "symbols_per_word": lambda c: c("n_symbols") / F.greatest(c("n_words"), F.lit(1)),
    "marks_per_word": lambda c: c("n_marks") / F.greatest(c("n_words"), F.lit(1)),
    "capitals_per_char": lambda c: c("n_capitals") / F.greatest(c("word_chars"), F.lit(1)),
    "dup_line_share": lambda c: c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1)),
    "repeat_share": lambda c: c("n_repeat_words") / F.greatest(c("n_words"), F.lit(1)),
}


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""
    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = let(pairs, lambda s: F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["p"],
        ))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(F.sort_array(twice), covered)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(
        F.slice(words, F.lit(1), F.size(words) - 2),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) >= 4, let(windows, repeated)).otherwise(F.lit(0).cast("long"))


def statistics(text: Column) -> Column:
    """Struct of the statistics of one text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))

    def of(words: Column, has: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(has) - F.size(F.array_distinct(has))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(has).cast("long").alias("n_lines"),
            (F.length(whole) - F.length(F.translate(whole, MARKS, ""))).cast("long").alias("n_marks"),
            F.length(F.regexp_replace(whole, r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
        )

    return let(words_of(text), lambda words: let(lines, lambda has: of(words, has)))


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED * stats["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.cut if self.above else row[self.feature] <= self.cut

    def column(self, stats: Column) -> Column:
        value = FEATURES[self.feature](lambda n: stats[n]).cast("double")
        return value >= F.lit(self.cut) if self.above else value <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _fits(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def _best_condition(rows: list[dict], taken: Rule) -> Condition | None:
    """The condition of highest FOIL gain; equal gains go to the first feature and cut."""
    bad, good = _counts(rows)
    if not bad or not good:
        return None
    before, best, choice = log2(bad / (bad + good)), 1e-9, None
    for feature in FEATURES:
        ordered = sorted((r[feature], r["bad"]) for r in rows)
        values = [v for v, _ in ordered]
        sums = [0]
        for _, b in ordered:
            sums.append(sums[-1] + b)
        cuts = sorted({values[min(len(values) - 1, k * len(values) // CUTS)] for k in range(CUTS + 1)})
        first, after, i = {}, {}, 0
        for cut in cuts:
            while i < len(values) and values[i] < cut:
                i += 1
            first[cut] = i
            j = i
            while j < len(values) and values[j] <= cut:
                j += 1
            after[cut] = j
        for cut in cuts:
            for above in (True, False):
                p = bad - sums[first[cut]] if above else sums[after[cut]]
                n = (len(values) - first[cut] if above else after[cut]) - p
                if p and p + n < len(values):
                    gain = p * (log2(p / (p + n)) - before)
                    if gain > best:
                        best, choice = gain, Condition(feature, above, float(cut))
    return None if choice in taken else choice


def learn(rows: list[dict], min_precision: float = MIN_PRECISION, max_rules: int = MAX_RULES) -> list[Rule]:
    """Ordered rules that reject, from rows of features with ``bad`` (0/1) and ``part`` (0..2; 2 prunes)."""
    grow, prune = [r for r in rows if r["part"] < 2], [r for r in rows if r["part"] == 2]
    found: list[Rule] = []
    while len(found) < max_rules and any(r["bad"] for r in grow):
        rule: Rule = ()
        covered = grow
        while len(rule) < MAX_CONDITIONS and (c := _best_condition(covered, rule)):
            rule, covered = (*rule, c), [r for r in covered if c.holds(r)]

        def precise(r: Rule) -> float:
            p, n = _counts([x for x in prune if _fits(r, x)])
            return (p + 1) / (p + n + 2) if p + n >= MIN_COVER else 0.0

        cuts = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(cuts, key=precise, default=())
        p, n = _counts([x for x in prune if _fits(rule, x)]) if rule else (0, 0)
        if not rule or p < MIN_COVER or p / (p + n) < min_precision:
            break
        found.append(rule)
        grow, prune = [r for r in grow if not _fits(rule, r)], [r for r in prune if not _fits(rule, r)]
    return found


def labelled(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """Features of a bounded sample of the labelled documents, in hash order; an id counts once per label, with its least features."""
    chosen = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).cast("int").alias("bad"))
    chosen = chosen.distinct().orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "bad").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    features = let(statistics(F.col("_text")), lambda s: F.struct(
        base_failed(s).alias("failed"), *[f(lambda n: s[n]).cast("double").alias(k) for k, f in FEATURES.items()],
    ))
    rows = rows.select("_id", "bad", features.alias("f")).groupBy("_id", "bad").agg(F.min("f").alias("f"))
    rows = rows.select("bad", F.pmod(F.xxhash64("_id", F.lit(seed + 1)), F.lit(3)).alias("part"), "f")
    found = [{"bad": r["bad"], "part": r["part"], **r["f"].asDict()} for r in rows.collect()]
    passed = [{k: v for k, v in r.items() if k != "failed"} for r in found if not r["failed"]]
    return sorted(passed, key=lambda r: tuple(r.values()))


def passes(rules: list[Rule], stats: Column) -> Column:
    """False for a text that fails the base rule or fits a rule of the list, in order."""
    verdict = F.when(base_failed(stats), F.lit(False))
    for rule in rules:
        fits = rule[0].column(stats)
        for c in rule[1:]:
            fits = fits & c.column(stats)
        verdict = verdict.when(fits, F.lit(False))
    return verdict.otherwise(F.lit(True))


def kept_texts(text: Column, rules: list[Rule]) -> Column:
    """Whether a text passes, as one expression that computes its statistics once."""
    return let(statistics(text), lambda stats: passes(rules, stats))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the statistics, ``base_failed`` and ``kept``."""
    results = [*STATS, "base_failed", "kept"]
    others = [c for c in docs.columns if c not in results]
    verdict = let(statistics(F.col(text)), lambda s: F.struct(*[s[n].alias(n) for n in STATS], base_failed(s).alias("base_failed"), passes(rules, s).alias("kept")))
    rows = docs.select(F.struct(*others).alias("doc"), verdict.alias("verdict"))
    return rows.select("doc.*", *[F.col(f"verdict.{r}").alias(r) for r in results])
