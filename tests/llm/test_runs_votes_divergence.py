"""Periodic runs, quality votes and source divergence against plain definitions, on awkward rows and on the smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import periodic_runs, quality_votes, source_divergence

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "Lorem ipsum dolor. " * 4000
AWKWARD = [(1, None), (2, ""), (3, "one"), (4, " \t\n\x0b "), (5, LONG), (6, LONG), (6, LONG), (None, "x y z"), (7, "a\u0000b ÄÖ é " * 9), (8, "w" * 50_000), (9, "one"), (10, "a a a a a a a b a a a a a")]
SCHEMA = "doc_id long, text string"
OWN = ["n", "RUNS", "Collapsed", "best", "N_Words", "kept", "Posterior", "base_failed", "_measures", "lang_", "term", "docs", "value", "a`b", "a.b", "h"]


def docs(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in OWN})


def same(ours, theirs):
    names = sorted(theirs.columns)
    key = lambda df: sorted(zip(*[[repr(v) for v in df[n].tolist()] for n in names], strict=True))
    return sorted(ours.columns) == names and key(ours) == key(theirs)


# ---------------------------------------------------------------- runs


def brute_runs(w, least=6, times=4):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and not any(all(w[k] == w[k + r] for k in range(i, j + q - r)) for r in range(1, q)):
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (3, 3)])
def test_runs_are_all_and_only_those_defined(least, times):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.choice([0, 1, 2, 5, 20, 60]), rng.choice([1, 2, 3, 10])
            t = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a, p = rng.randrange(n), rng.randint(1, 4)
                t = [t[i] if i < a else t[a + (i - a) % p] for i in range(n)]
            texts.append(t)
        got = {}
        for of, *run in zip(*[x.tolist() for x in periodic_runs.runs([np.array(t, np.int64) for t in texts], least, times)], strict=True):
            got.setdefault(of, []).append(tuple(run))
        assert [got.get(i, []) for i in range(len(texts))] == [brute_runs(t, least, times) for t in texts]


@pytest.mark.parametrize("jumps", [0, 1, 16])
def test_next_below(monkeypatch, jumps):
    monkeypatch.setattr(periodic_runs, "JUMPS", jumps)
    x = list(range(300))
    random.Random(1).shuffle(x)
    for v in (x, range(50), range(50, 0, -1), [0, *range(60, 0, -1)], [5], []):
        v = np.array(list(v), np.int64)
        assert periodic_runs.next_below(v).tolist() == [next((j for j in range(i + 1, len(v)) if v[j] < v[i]), len(v)) for i in range(len(v))]


def test_common_prefixes():
    rng = np.random.default_rng(4)
    key = np.append(rng.integers(1, 3, 200), 0)
    order, levels = periodic_runs.suffix_array(key)
    assert order.tolist() == sorted(range(201), key=lambda i: key[i:].tolist())
    a, b = rng.integers(0, 200, (2, 300))
    a, b = a[a != b], b[a != b]
    shared = lambda i, j: next(k for k in range(201) if key[i + k] != key[j + k])
    assert periodic_runs.Prefixes(order, levels)(a, b).tolist() == [shared(i, j) for i, j in zip(a, b, strict=True)]


def brute_digest(doc_id, text, plant=True):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if plant and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (len(runs), s, m, q, m and 1000 * m // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query_against_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.query(spark, DIR).collect()}
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    some = [r for r in rows if len(r.text) < 8000]
    assert len(some) > 150 and len(got) == len(rows)
    assert any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in some)
    assert {r.doc_id: got[r.doc_id] for r in some} == {r.doc_id: brute_digest(r.doc_id, r.text) for r in some}


def test_runs_cases(spark, tmp_path):
    got = periodic_runs.find(docs(spark))
    assert got.columns == ["doc_id", "text", *[c for c in OWN if c.lower() not in ("runs", "collapsed")], "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == len(AWKWARD)
    by = {r.doc_id: r for r in rows}
    assert by[1].runs == [] and by[1].collapsed == "" and by[3].collapsed == "one" and by[8].collapsed == "w" * 50_000
    assert [tuple(r) for r in by[10].runs] == [(0, 7, 1)] and by[10].collapsed == "a b a a a a a"
    assert [tuple(r) for r in by[5].runs] == [(0, 12_000, 3)] and by[5].collapsed == "Lorem ipsum dolor."
    assert [tuple(r) for r in by[7].runs] == [(0, 18, 2)] and by[10]["a`b"] == "own a`b"
    assert periodic_runs.find(docs(spark, [])).count() == 0
    spark.createDataFrame(AWKWARD, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, tuple(r)[1:]) for r in periodic_runs.query(spark, str(tmp_path)).collect())
    assert got == Counter((i, brute_digest(i, t)) for i, t in AWKWARD)


def test_slices_do_not_matter(spark, monkeypatch):
    rows = [w.split() for w in ("a b a b a b a b c", "", "x", "a b a b a b a b", "b b b b b b")]
    alone = [[tuple(int(x[0]) for x in p) for p in zip(*[[[v] for v in x.tolist()] for x in periodic_runs.runs([n])[1:]], strict=True)] for n in periodic_runs.numbered([[w.encode() for w in r] for r in rows])]
    of, *parts = periodic_runs.runs(periodic_runs.numbered([[w.encode() for w in r] for r in rows]))
    assert [[tuple(int(p[k]) for p in parts) for k in np.flatnonzero(of == i)] for i in range(len(rows))] == alone == [[(0, 8, 2)], [], [], [(0, 8, 2)], [(0, 6, 1)]]


# ---------------------------------------------------------------- votes


def brute_measures(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(twice),
        "n_lines": len(lines), "n_distinct_words": len(set(w)), "n_capitals": len(re.findall("[A-Z]", t)), "n_digits": len(re.findall("[0-9]", t)), "n_ends": len(re.findall("[.!?]", t)),
        "n_odd_words": sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), "n_plain_words": sum(bool(re.match(r"[^\W\d_]+[.,;:?!]?$", x)) for x in w),
    }


def test_measures(spark):
    rng = random.Random(3)
    made = [(100 + i, " ".join(rng.choice("ab") if rng.random() < 0.97 else "\n" for _ in range(rng.randrange(60)))) for i in range(40)]
    rows = [*AWKWARD, *made, (500, "x #y\n\nx #y\r\nx #y\n \nz"), (501, "one two three four five six seven eight " * 2 + "nine"), (502, "a\n" * 3 + "3.14 <b> ÉTÉ naïve, x1")]
    got = [{m: r[m] for m in quality_votes.MEASURES} for r in quality_votes.measured(docs(spark, rows)).orderBy(F.monotonically_increasing_id()).collect()]
    key = lambda d: sorted(d.items())
    assert sorted(map(key, got)) == sorted(key(brute_measures(t)) for _, t in rows)
    assert all(type(v) is int for d in got for v in d.values())


def test_votes_against_sql(spark):
    for folder in (DIR, "/root/testdata/sf0.01"):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        got = quality_votes.query(spark, folder).toPandas()
        assert same(got, c.sql(quality_votes.SQL).df())
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    assert both[both.quality == 1].kept.mean() > 0.95 and both[both.quality == 0].kept.mean() < 0.1


def test_no_python_in_the_votes(spark):
    rows = quality_votes.measured(spark.read.parquet(f"{DIR}/documents.parquet"))
    plan = quality_votes.judge(rows, quality_votes.fit(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.split("Physical Plan")[1].count("array_distinct(") < 8  # measures are computed once, not once a field


def test_estimate_against_a_loop(spark):
    rng = np.random.default_rng(0)
    rules = tuple(quality_votes.Rule(f"r{i}", f"v{i} = 1", f"v{i} = 0") for i in range(4))
    good = rng.random(3000) < 0.7
    votes = np.stack([np.where(rng.random(3000) < 0.2, -1, np.where(good, rng.random(3000) < a, rng.random(3000) > b)) for a, b in ((0.95, 0.7), (0.9, 0.6), (0.99, 0.5), (0.8, 0.8))], 1)
    rows = spark.createDataFrame([tuple(map(int, v)) for v in votes], ", ".join(f"v{i} int" for i in range(4)))
    share, g, b = quality_votes.START[0], np.full(4, quality_votes.START[1]), np.full(4, quality_votes.START[2])
    w = quality_votes.PRIOR
    for _ in range(quality_votes.ROUNDS):
        logit = math.log(share / (1 - share)) + (np.where(votes == 1, np.log(g / (1 - b)), 0) + np.where(votes == 0, np.log((1 - g) / b), 0)).sum(1)
        p = 1 / (1 + np.exp(-logit))
        share = (p.sum() + w * quality_votes.START[0]) / (len(p) + w)
        g = ((p[:, None] * (votes == 1)).sum(0) + w * quality_votes.START[1]) / ((p[:, None] * (votes >= 0)).sum(0) + w)
        b = (((1 - p)[:, None] * (votes == 0)).sum(0) + w * quality_votes.START[2]) / (((1 - p)[:, None] * (votes >= 0)).sum(0) + w)
    got = quality_votes.fit(rows, rules)
    assert math.isclose(got.share, share) and np.allclose(got.good, g) and np.allclose(got.bad, b)
    assert np.abs(np.array(got.good) - (0.95, 0.9, 0.99, 0.8)).max() < 0.05 and np.abs(np.array(got.bad) - (0.7, 0.6, 0.5, 0.8)).max() < 0.1
    assert quality_votes.fit(rows.limit(0), rules).share == quality_votes.START[0]


def test_votes_cases(spark):
    rows = quality_votes.measured(docs(spark))
    got = quality_votes.judge(rows, quality_votes.fit(rows))
    assert sorted(got.columns) == sorted(["doc_id", "text", *[c for c in OWN if c.lower() not in ("n_words", "kept", "posterior", "base_failed")], *quality_votes.MEASURES, "base_failed", "posterior", "kept"])
    out = got.collect()
    assert len(out) == len(AWKWARD) and all(r.base_failed and not r.kept for r in out if r.n_words < 20) and all(0 <= r.posterior <= 1 for r in out)
    assert {r.base_failed for r in out if r.doc_id == 5} == {True}  # a repeated sentence
    none = quality_votes.measured(docs(spark, []))
    assert quality_votes.judge(none, quality_votes.fit(none)).count() == 0


# ---------------------------------------------------------------- divergence


def against_sql(spark, rows):
    c = duckdb.connect()
    frame = rows.select("text", "lang", "source").toArrow()
    c.register("documents", frame)
    return same(source_divergence.divergence(rows).toPandas(), c.sql(source_divergence.SQL).df())


def test_divergence_against_sql(spark):
    for folder in (DIR, "/root/testdata/sf0.01"):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        got = source_divergence.query(spark, folder).toPandas()
        assert same(got, c.sql(source_divergence.SQL).df()) and str(got["rank"].dtype) == "int32"


def test_divergence_cases(spark, monkeypatch):
    schema = "text string, lang string, source string"
    rng = random.Random(1)
    rows = [(" ".join(rng.choice(["Äpfel", "tree", "TREE", "x1y", "the", "of", "a-b", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(60))), rng.choice(["en", "en", "", None]), rng.choice(["s1", "s2", "é", None, "S3"])) for _ in range(300)]
    rows += [(None, "xx", "one"), ("", "xx", "two"), ("lonely", "xx", None), (" \u0000@[`{\u007f ", "en", "void"), ("tree " * 50_000, "en", "s1"), *[("same words here", "en", "s1")] * 5]
    d = spark.createDataFrame(rows, schema).withColumns({c: F.lit("own") for c in ("term", "n", "Docs", "id", "p0", "value", "item", "rank", "a`b")})
    assert against_sql(spark, d)
    for name, most in (("HELD", 3), ("STRETCH", 5), ("PAIRS", 7)):
        monkeypatch.setattr(source_divergence, name, most)
    assert against_sql(spark, d.repartition(5))
    got = source_divergence.divergence(d).where("lang = 'xx'").collect()
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in got) == [("", "one", 0, 1), ("", "two", 0, 2), ("one", "", 0, 1), ("one", "two", 0, 2), ("two", "", 0, 1), ("two", "one", 0, 2)]
    assert source_divergence.divergence(d.limit(0)).count() == 0


def test_shares_of_large_counts(spark):
    """Products beyond a long stay exact."""
    rows = [(9_000_000_000, 30_000_000_001, 77), (0, 0, 1), (5, 10, 3), (10**12, 10**12, 5)]
    d = spark.createDataFrame(rows, "c long, t long, v long")
    got = [r.s for r in d.select(source_divergence.share(F.col("c"), F.col("t"), F.col("v")).alias("s")).collect()]
    assert got == [1 + 10**9 * (c + 1) // (t + v) for c, t, v in rows]
