"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill.llm import periodic, permutation, phrases, registry
from clausemill.session import table


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# --- 11


def plain_nearest(rows, k, every):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in good), default=0)
    ids, x = np.array([i for i, _ in good], np.int64), np.array([[*v, *[0.0] * (width - len(v))] for _, v in good], np.float64).reshape(len(good), width)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        found = [(float(np.sqrt(((v - x[j]) ** 2).sum())), i) for j in np.flatnonzero(ids == q) for i, v in zip(ids.tolist(), x) if i != q]
        out[q] = [(i, d) for d, i in sorted(found)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in sorted(collected(df), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_neighbours_of_odd_rows_when_all_are_measured(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(60 + i, rows[0][1]) for i in range(30)]  # repeats, more than k
    rows += [(None, [1.0] * 5), (95, None), (96, []), (97, [0.0] * 5), (98, [1.0, None]), (99, [float("nan")] * 5), (100, [float("inf")] * 5), (40, rng.normal(size=5).tolist()), (101, [1.0, 2.0]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, row int, order string").repartition(3)
    for block in (8192, 16):
        monkeypatch.setattr(permutation, "BLOCK", block)
        monkeypatch.setattr(permutation, "TOGETHER", block)
        got, want = as_lists(permutation.nearest(df, k=7, every=20, share=1.0)), plain_nearest(rows, 7, 20)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
            assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], rtol=0, atol=1e-12)
    assert permutation.nearest(df.where("vec_id < 0")).count() == 0
    few = as_lists(permutation.nearest(df.where("vec_id in (20, 21, 22)"), every=20))
    assert len(few[20]) == 2


@pytest.mark.parametrize("hot", [False, True])
def test_neighbours_recall(spark, hot):
    df = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding")
    if hot:  # a third of all rows lie close to one vector
        near = F.expr("transform(embedding, (x, i) -> CAST(sin(i) + x / 20 AS FLOAT))")
        df = df.unionByName(df.where("vec_id % 2 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), near.alias("embedding")))
    got = as_lists(permutation.nearest(df))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = plain_nearest(rows, 10, 100)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert got.keys() == want.keys() and np.mean(hits) >= 0.95


def test_footrule_and_pivots():
    rng = np.random.default_rng(4)
    sample = np.r_[np.repeat(rng.normal(size=(1, 3)), 50, axis=0), rng.normal(size=(20, 3))]
    pivots = permutation.spread_pivots(sample, 30)
    assert len(pivots) == 21 == len(np.unique(pivots, axis=0))
    orders = permutation.positions(sample, pivots)
    assert (np.sort(orders, axis=1) == np.arange(21)).all()
    far = permutation.footrule(np.ascontiguousarray(orders.T), orders[60])
    assert far.tolist() == np.abs(orders.astype(int) - orders[60].astype(int)).sum(axis=1).tolist()
    assert len(permutation.spread_pivots(np.zeros((0, 0)), 5)) == 0


# --- 12


def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check_runs(source, got):
    want = []
    for r in source:
        w = words(r["text"])
        runs = plain_runs(w)
        want.append((r["doc_id"], len(w), tuple(runs), plain_collapsed(w, runs)))
    assert Counter((r["doc_id"], r["n_words"], tuple((x["start"], x["length"], x["period"]) for x in r["runs"]), r["collapsed"]) for r in got) == Counter(want)


def repetitive_texts():
    rng = random.Random(2)
    texts = ["a " * 40, "a b " * 3, "a b " * 2, "x a b c a b c a b c a b c a y", "a a a a a a b a a a a a a b a a a a a a b a a a a a a b", "A a " * 9 + "\x1c \x0b a\x1ca", "la " * 5]
    for _ in range(60):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 4))]
        texts.append(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) + " " + " ".join(unit * rng.randint(2, 9)) + " " + " ".join(rng.choice("ab") for _ in range(rng.randint(0, 20))))
    return texts


def test_periodic_runs_odd_rows(spark, odd_docs, no_docs):
    short = odd_docs.where(F.length("text") < 5000).unionByName(odd_docs.where("text is null"))
    check_runs(collected(short), collected(periodic.periodic_runs(short)))
    long = collected(periodic.periodic_runs(odd_docs.where(F.length("text") >= 5000)))
    assert sorted((r["n_words"], len(r["runs"]), r["runs"][0]["period"], r["runs"][0]["length"], r["collapsed"]) for r in long) == [
        (20000, 1, 5, 20000, "wordy text of some length"),
        (20001, 1, 5, 20000, "wordy text of some length tail"),
    ]
    assert periodic.periodic_runs(no_docs).count() == 0


def test_periodic_runs_of_repetitive_texts_whole_and_in_ranges(spark):
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(repetitive_texts())], "doc_id bigint, text string").repartition(2)
    check_runs(collected(df), collected(periodic.periodic_runs(df)))
    # so little work for a task that nearly every text is dealt in ranges of shifts
    check_runs(collected(df), collected(periodic.periodic_runs(df, work=40)))


def test_op12_against_its_contract(spark, data):
    got = {r["doc_id"]: r for r in collected(registry.op12_periodic(spark, data))}
    source = [r for r in collected(table(spark, data, "documents")) if len(r["text"] or "") < 12000]
    planted = 0
    for r in source:
        w = words(r["text"])
        h = zlib.crc32(str(r["doc_id"]).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        want = {"doc_id": r["doc_id"], "n_runs": len(runs), "start": s, "length": length, "period": q, "exponent_milli": 1000 * length // q if runs else None}
        want["runs_sha256"] = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        want["collapsed_sha256"] = hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest()
        assert got[r["doc_id"]] == want
    assert planted > 5


# --- 13


def plain_phrases(rows, top, least, part):
    f, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for n in (1, 2, 3):
                f.update((lang, tuple(w[i : i + n])) for i in range(len(w) - n + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least or len(p) == 2 and any(100 * f[lang, q] >= part * a for q in longer.get((lang, p), ())):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], sizes[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return ranked


def longer_of(rows, least):
    global longer
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({i: i + 32 for i in range(65, 91)})):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(("und" if lang is None else lang, tuple(w[i : i + 3])) for i in range(len(w) - 2))
    longer = {}
    for (lang, p), a in f.items():
        if a >= least:
            longer.setdefault((lang, p[:2]), []).append(p)
            longer.setdefault((lang, p[1:]), []).append(p)


@pytest.mark.parametrize("grouped", [4_000_000, 50])
def test_phrases_odd_rows(spark, odd_docs, no_docs, monkeypatch, grouped):
    monkeypatch.setattr(phrases, "GROUPED", grouped)  # many small ranges
    rng = random.Random(5)
    made = [("en" if i % 3 else None, " ".join(rng.choices(["The", "the", "ÉTÉ", "été", "\x00", "x", "y z", "of", "a,b"], [5, 3, 1, 1, 1, 2, 1, 4, 1], k=40))) for i in range(40)]
    df = odd_docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(made)], "doc_id bigint, text string, lang string")).withColumn("word", F.lit(1)).withColumn("phrase", F.lit("x"))
    rows = [(r["lang"], r["text"]) for r in df.collect()]
    longer_of(rows, 3)
    got = [(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collected(phrases.collocations(df, top=25, least=3))]
    assert sorted(got) == sorted(plain_phrases(rows, 25, 3, 50)) and len(got) > 25
    assert phrases.collocations(no_docs).count() == 0


def test_phrases_against_sql(spark, data):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = c.sql(registry.oracle_sql()["op13_phrases"]).fetchall()
    assert sorted(map(tuple, registry.op13_phrases(spark, data).collect())) == sorted(want) and want


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**12 + 7, 3 * 10**12 + 1, 10**13), (10**15 - 1, 10**15 - 1, 10**15 - 1), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(phrases._score("a", "l", "r")).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (x * y) for a, x, y in rows]


def test_radix_order_and_counts():
    rng = np.random.default_rng(6)
    keys = rng.integers(0, 3, (5000, phrases.KEY)).astype(np.uint8)
    found, times = phrases.counted(keys, np.ones(len(keys), np.int64))
    want = Counter(k.tobytes() for k in keys)
    assert [(k.tobytes(), t) for k, t in zip(found, times.tolist())] == sorted(want.items())
    assert len(phrases.counted(keys[:0], np.zeros(0, np.int64))[0]) == 0
