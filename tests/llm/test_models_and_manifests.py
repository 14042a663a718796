"""Language model, periodic runs and Merkle manifest against brute force on small tables."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import language_model, merkle, periodic, queries
from tests.llm.test_operators import FOLDER, ODD, ODD_SCHEMA, WORD, rows, words


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


def documents(spark):
    return rows(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# 11. Language model

def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


class BruteModel:
    def __init__(self, texts, order):
        self.order, self.counts = order, {k: Counter() for k in range(1, order + 1)}
        for t in texts:
            s = self.symbols(t)
            for i in range(1, len(s)):
                if i >= order - 1:
                    self.counts[order][tuple(s[i - order + 1 : i + 1])] += 1
                else:
                    self.counts[i + 1][tuple(s[: i + 1])] += 1
        for k in range(order - 1, 0, -1):
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += 1
        self.raw = Counter(w for t in texts for w in self.symbols(t)[1:])
        self.discounts, self.contexts = {}, {}
        for k, counts in self.counts.items():
            c = Counter(counts.values())
            self.discounts[k] = (0, *language_model.discounts((c[1], c[2], c[3], c[4])))
            self.contexts[k] = defaultdict(lambda: [0, 0, 0, 0])
            for g, n in counts.items():
                x = self.contexts[k][g[:-1]]
                x[0] += n
                x[min(n, 3)] += 1

    @staticmethod
    def symbols(text):
        return ["<s>", *WORD.findall(lower(text)), "</s>"]

    def p(self, g):
        low = self.p(g[1:]) if len(g) > 1 else 1 / (len(self.raw) + 1)
        x, d = self.contexts[len(g)].get(g[:-1]), self.discounts[len(g)]
        if not x:
            return low
        n = self.counts[len(g)].get(g, 0)
        return max(n - d[min(n, 3)], 0) / x[0] + sum(d[i] * x[i] for i in (1, 2, 3)) / x[0] * low

    def score(self, text):
        s, total = self.symbols(text), sum(self.raw.values())
        base = sum(math.log10((self.raw[w] + 1) / (total + len(self.raw) + 1)) for w in s[1:])
        return len(s) - 1, sum(self.raw[w] > 0 for w in s[1:]), base, sum(math.log10(self.p(tuple(s[max(0, i - self.order + 1) : i + 1]))) for i in range(1, len(s)))


def made_texts():
    r = random.Random(3)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(5000)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", " \n", "Hot hot HOT " * 400]


@pytest.mark.parametrize("order,shard_bytes,hot", [(2, 2000, 30), (2, 10**9, 10**9), (3, 2000, 30), (4, 4000, 10), (1, 2000, 5)])
def test_language_model_is_brute_force(spark, order, shard_bytes, hot):
    texts = made_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = language_model.fit(docs.where("doc_id % 3 <> 0"), order=order, shard_bytes=shard_bytes, hot=hot)
    brute = BruteModel([t for i, t in enumerate(texts) if i % 3], order)
    assert (model.n_tokens, model.n_words) == (sum(brute.raw.values()), len(brute.raw))
    got = {r["doc_id"]: r for r in rows(language_model.score(docs, language_model.Model.load(model.folder)))}
    for i, t in enumerate(texts):
        n, known, base, score = brute.score(t)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-12) and got[i]["score"] == pytest.approx(score, rel=1e-12)
        assert got[i]["perplexity"] == pytest.approx(10 ** (-score / n))


def test_language_model_sums_to_one(spark):
    texts = made_texts()[:40]
    model = language_model.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)
    known = sorted({w for t in texts for w in words(t)})
    ends = [*known, "", "unseen"]  # the empty word is the end
    for before in ([], ["w1"], ["w2", "w1"], ["w1", "unseen"], ["unseen", "unseen"]):
        total = 0.0
        for e in ends:
            chunks = language_model.Chunks(10**6, 3)
            list(chunks.add(0, " ".join([*before, e])))
            _, p = language_model.probabilities(model, chunks.close())
            total += p[len(before)]
        assert total == pytest.approx(1, abs=1e-9)


def test_long_texts_are_cut_into_chunks(spark, monkeypatch):
    """A chunk that ends inside a text leaves its last words to the next as history."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(9)}" for _ in range(r.choice([0, 1, 5, 700]))) for _ in range(12)] + [None]
    model = language_model.fit(spark.createDataFrame([(t,) for t in texts], "text string"), order=3)

    def scores():
        chunks, out = language_model.Chunks(language_model.STEP, 3), np.zeros(len(texts))
        done = [c for i, t in enumerate(texts) for c in chunks.add(i, t)]
        for c in [*done, chunks.close()] if chunks.parts else done:
            out += np.bincount(c.row[c.carried :], np.log10(language_model.probabilities(model, c)[1]), minlength=len(texts))
        return len(done), out

    whole = scores()
    monkeypatch.setattr(language_model, "STEP", 40)
    monkeypatch.setattr(language_model, "PIECE", 30)
    cut = scores()
    assert whole[0] == 0 and cut[0] > 50 and np.allclose(whole[1], cut[1], rtol=1e-12)


def test_pairs_are_numbered_either_way():
    r = np.random.default_rng(2)
    for high in (5, 2**31, 2**45):
        a, b = r.integers(0, high, 500), r.integers(0, 6, 500)
        a[::2] = a[1::2]
        ids, first, n = language_model._pairs(a, b)
        want = sorted(set(zip(a.tolist(), b.tolist())))
        assert [(int(a[i]), int(b[i])) for i in first] == want and [want[i] for i in ids] == list(zip(a.tolist(), b.tolist()))
        assert n.tolist() == [Counter(zip(a.tolist(), b.tolist()))[w] for w in want]


def test_language_model_query(spark):
    docs = documents(spark)
    held = {d["doc_id"]: crc(d["doc_id"]) % 7 == 2 for d in docs}
    brute = BruteModel([d["text"] for d in docs if not held[d["doc_id"]]], language_model.ORDER)
    got = rows(queries.op11_language_model(spark, FOLDER))
    assert len(got) == len(docs)
    texts = {d["doc_id"]: d["text"] for d in docs}
    for r in got:
        n, known, base, score = brute.score(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], n, known, sum(brute.raw.values()))
        assert r["base_score"] == pytest.approx(base, rel=1e-12) and r["score"] == pytest.approx(score, rel=1e-12)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better on texts it has not seen


def test_language_model_odd_tables(spark, odd):
    model = language_model.fit(odd)
    got = rows(language_model.score(odd, model))
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert "kept" in got[0] and "text" not in got[0]
    empty = language_model.fit(odd.limit(0))
    assert {r["score"] for r in rows(language_model.score(odd, empty))} == {0.0}
    assert language_model.score(odd.limit(0), model).count() == 0


def test_array_files_are_replaced_whole(tmp_path):
    table = language_model.Table(str(tmp_path), 4)
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64))
    for _ in range(2):  # a task that runs twice
        for shard in range(3):  # the last shard holds nothing
            own = keys[table.place(keys) == shard]
            table.save(shard, own, np.arange(len(own)) + 1)
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".")]
    found = table.find(np.concatenate([keys, keys + np.uint64(1)]))[:, 0]
    assert ((found[: len(keys)] > 0) == (table.place(keys) < 3)).all() and not found[len(keys) :].any()


# 12. Periodic runs

def brute_runs(x, shortest=6, times=4):
    out = {}
    for q in range(1, len(x) // times + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda t: (t[0], t[2]))


def periodic_texts(r, n):
    for _ in range(n):
        size, letters = r.randint(0, 300), r.choice([1, 2, 3, 5, 50])
        x = [r.randrange(letters) for _ in range(size)]
        for _ in range(r.randint(0, 3)):
            if size > 10:
                a = r.randrange(size)
                p = r.randint(1, max(1, (size - a) // 3))
                for i in range(a, min(size, a + r.randint(1, size))):
                    x[i] = x[a + (i - a) % p]
        yield x


def test_word_runs_are_brute_force(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    monkeypatch.setattr(periodic, "ROWS", 7)
    for x in periodic_texts(random.Random(1), 1500):
        assert [tuple(map(int, t)) for t in periodic.word_runs(np.array(x, np.int32))] == brute_runs(x)


def test_cover_brings_all_residues_together():
    for a in range(periodic.MODULUS):
        for b in range(periodic.MODULUS):
            d = periodic._DISTANCE[a, b]
            assert {(a + d) % periodic.MODULUS, (b + d) % periodic.MODULUS} <= set(periodic.COVER.tolist())


def test_extensions_are_brute_force():
    r = random.Random(4)
    for x in periodic_texts(r, 200):
        n = len(x)
        if n < 2:
            continue
        i = np.array([r.randrange(n - 1) for _ in range(50)])
        j = np.array([r.randint(a + 1, n) for a in i])
        want = [next((k for k in range(n - b) if x[a + k] != x[b + k]), n - b) for a, b in zip(i, j)]
        assert periodic.Extensions(np.array(x, np.int32)).common(i, j).tolist() == want


def test_long_and_odd_texts_with_runs(spark, odd):
    same = "echo " * 50_000
    lines = "some line that comes\tback\n" * 3_000
    made = spark.createDataFrame([(20, same, "r"), (21, lines, "s"), (22, None, "t")], "doc_id long, text string, runs string")
    got = {r["doc_id"]: r for r in rows(periodic.periodic_runs(made))}
    assert [tuple(x) for x in got[20]["runs"]] == [(0, 50_000, 1)] and got[20]["collapsed"] == "echo"
    assert [tuple(x) for x in got[21]["runs"]] == [(0, 15_000, 5)] and got[21]["collapsed"] == "some line that comes back"
    assert (got[22]["n_words"], got[22]["runs"], got[22]["collapsed"]) == (0, [], "")
    got = rows(periodic.periodic_runs(odd))
    assert len(got) == len(ODD) and {"kept", "rank"} <= set(got[0])
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


def test_periodic_query(spark):
    want = {}
    for d in documents(spark):
        w, h = words(d["text"]), crc(d["doc_id"])
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda t: (t[1] / t[2], -t[0], -t[2]), default=None)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[d["doc_id"]] = (
            len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
        )
    got = queries.op12_periodic_runs(spark, FOLDER)
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in rows(got)} == want
    assert sum(v[0] > 0 for v in want.values()) > 5


# 13. Merkle manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves, fanout=3):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    proofs = []
    for i in range(len(leaves)):
        proof = []
        for level in levels[:-1]:
            a = i - i % fanout
            proof.append(("".join(level[a:i]), "".join(level[i + 1 : a + fanout])))
            i //= fanout
        proofs.append(proof)
    return levels[-1][0], proofs


def brute_manifest(table, fanout=3):
    groups = {}
    for r in table:
        groups.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), brute_leaf(r), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    found = []
    for k in keys:
        leaves = sorted(groups[k], key=lambda t: t[:2])
        found.append((leaves, *brute_tree([x[1] for x in leaves], fanout)))
    root, tops = brute_tree([f[1] for f in found], fanout)
    return [(x[2], x[1], sub, root, p + top) for (leaves, sub, proofs), top in zip(found, tops) for x, p in zip(leaves, proofs)]


NAMES = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, proof string, digest string, at int"


@pytest.mark.parametrize("levels,fanout,n,groups", [(1, 3, 400, 7), (2, 3, 700, 3), (0, 3, 60, 40), (7, 3, 100, 4), (1, 2, 200, 5)])
def test_manifest_is_brute_force(spark, levels, fanout, n, groups):
    r = random.Random(levels * 100 + n)
    names = [None, "é", "a", "", *[f"s{i}" for i in range(groups)], *["hot"] * groups]
    table = [(r.choice([None, *range(300)]), r.choice(names), "en", 5, r.choice([None, "x\ny", "ab"])) for _ in range(n)]
    docs = spark.createDataFrame([(*t, "p", "d", 1) for t in table], SCHEMA)
    got = merkle.manifest(docs, merkle.leaf_of(*NAMES), "source", "doc_id", fanout, levels)
    assert {"digest", "at"} <= set(got.columns)
    mine = [(tuple(x[c] for c in NAMES), x["leaf"], x["subroot"], x["root"], [tuple(p) for p in x["proof"]]) for x in got.collect()]
    assert sorted(mine, key=str) == sorted(brute_manifest(table, fanout), key=str)
    folded = got.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).distinct().collect()
    assert [x["ok"] for x in folded] == [True]


def test_manifest_of_equal_rows_and_nothing(spark):
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one").alias("source"), F.lit("t").alias("text"))
    got = merkle.manifest(docs, merkle.leaf_of("doc_id", "source", "text"), "source", "doc_id", levels=3)
    ok = got.groupBy((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok")).count().collect()
    assert [(x["ok"], x["count"]) for x in ok] == [(True, 2000)]
    assert got.select("proof").distinct().count() > 600  # equal rows have places of their own
    assert merkle.manifest(docs.limit(0), merkle.leaf_of("doc_id"), "source", "doc_id").count() == 0


def test_manifest_query(spark):
    docs = documents(spark)
    want = {x[0][0]: x for x in brute_manifest([tuple(d[c] for c in NAMES) for d in docs])}
    got = rows(queries.op13_merkle_manifest(spark, FOLDER))
    assert len(got) == len(docs)
    for r in got:
        row, leaf, subroot, root, proof = want[r["doc_id"]]
        tampered = crc(r["doc_id"]) % 2 == 0 and row[4] is not None
        x = brute_leaf((*row[:4], row[4].replace("\n", "") if tampered else row[4]))
        for left, right in proof:
            x = digest(left, x, right)
        assert (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) == (leaf, subroot, root, digest(*(a + b for a, b in proof)))
        assert (r["folded_root"], r["verified"]) == (x, x == root)
    assert {r["verified"] for r in got} == {True, False}
