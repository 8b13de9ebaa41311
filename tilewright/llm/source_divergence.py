"""Source divergence audit: how far the word use of every source of a language lies from every other's, and the terms that set it apart.

An inverted index has one row a kept term of a language, with the sources that use it and how often. A source gives a term that it does not use the same share p0 as any
other such term, so a pair of sources g, h starts at V * f(p0 of g, p0 of h), V the language's kept terms, and only terms that one of
them uses correct it. A term of g alone changes the pair by m * (f(p, p0 of h) - f(p0 of g, p0 of h)): that depends on p alone, so terms are counted by p and source first. For
a term of both, a task adds f(p, q) - f(p, p0 of h) - f(p0 of g, q) + f(p0 of g, p0 of h) into sums of the pairs it meets, and hands only these
on. Whole numbers throughout: a share is 1 + floor(10^9 * (count + 1) / (N + V)), f is floor((p - q)^2 / q).

Null text, lang and source count as empty. Texts of any length are read whole, long ones in stretches that end between terms; a task hands its counts on before they take
much memory. A source without terms, or of a language without kept terms, has pairs of its own value; its items are no terms. Repeated rows are documents of their own. Ties go to
the item first in UTF-8. An empty table gives no rows. Columns other than text, lang and source are not read.

Hot sources: counts are added up in the tasks that read the texts and then dealt by term, so no task holds a source; the ranks of terms keep 200 rows a
source in each task before any shuffle. A row of the index is as long as the language has sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain, stored, table
from .text import buffers, released

#: Documents of its language that a kept term is in, at least; terms listed for a source, at most.
LEAST, TOP = 3, 200
SCALE = 1_000_000_000
#: Counts that a task holds before it hands them on; bytes of a text that are split at once; pairs of sources that are worked on at once.
HELD, STRETCH, PAIRS = 1 << 18, 1 << 22, 1 << 20
#: Bytes of a term, A-Z as a-z; all others become blanks. Every byte of a character beyond ASCII is 128 or more.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial counts of occurrences and of documents, to be added up; a null term says that the source occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (a, b), (n, d) in counts.items():
                terms = pa.array(list(n), pa.binary()).view(pa.string())
                same = lambda v: pa.repeat(pa.scalar(v, pa.string()), len(n))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([same(a), same(b), terms, pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())], names)
            counts.clear()

        names = ["lang", "source", "term", "n", "docs"]
        held = 0
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for key, a, b in zip(keys, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                seen.add(key)
                if key not in counts:
                    counts[key] = (Counter(), Counter())
                n, d = counts[key]
                before, own = len(n), set()
                row = data[a:b].tobytes().translate(_TERM)
                at = 0
                while at < len(row):
                    end = row.find(b" ", at + STRETCH)
                    terms = row[at : end if end >= 0 else len(row)].split()
                    n.update(terms)
                    own.update(terms)
                    at = end if end >= 0 else len(row)
                d.update(own)
                held += len(n) - before
                if held >= HELD:
                    yield from handed()
                    held = 0
        yield from handed()
        if seen:
            langs, sources = zip(*sorted(seen), strict=True)
            none = pa.nulls(len(seen), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sources, pa.string()), none, *[pa.array([0] * len(seen), pa.int64())] * 2], names)

    filled = docs.select(*[F.coalesce(F.col(plain(c)).cast("string"), F.lit("")).alias(k) for k, c in (("text", text), ("lang", lang), ("source", source))])
    return filled.mapInArrow(released(run), "lang string, source string, term string, n long, docs long")


def index(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, uses: array of (source, n)) of every kept term, and of each language a row with a null term that lists all its sources. Dealt once, by language and term."""
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = each.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return rows.where(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + terms)), in decimals: the product may not fit a long."""
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    return 1 + F.call_function("div", wide(F.lit(SCALE), 10) * wide(count + 1, 20), wide(total + terms, 20))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): sums of the corrections of terms that both sources use, for ordered pairs, from rows (lang, ids, p, p0): a term's sources, ascending, their share of it, and
    of a term they do not use. Sums of a task, to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            return (p - q) ** 2 // q

        def added(lang: str, of: np.ndarray, value: np.ndarray) -> None:
            if lang in sums:
                of, value = np.concatenate((sums[lang][0], of)), np.concatenate((sums[lang][1], value))
            order = np.argsort(of, kind="stable")
            of, value = of[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            sums[lang] = of[first], np.add.reduceat(value, first)

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, (of, value) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(of)), pa.array(of >> 32), pa.array(of & 0xFFFFFFFF), pa.array(value)], ["lang", "a", "b", "value"])
            sums.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            size = np.diff(batch.column(1).offsets.to_numpy())
            ids, p, p0 = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
            first = np.concatenate(([0], np.cumsum(size)))
            for k, lang in enumerate(names):
                rows = np.flatnonzero((code == k) & (size > 1))
                # every use of a term meets all others of that term; some uses at a time
                use = np.repeat(first[rows], size[rows]) + np.arange(size[rows].sum()) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
                start, n = np.repeat(first[rows], size[rows]), np.repeat(size[rows], size[rows])
                cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), PAIRS), "left"))
                for s, e in zip(cuts, np.append(cuts[1:], len(n)), strict=True):
                    m = n[s:e]
                    a = np.repeat(use[s:e], m)
                    b = np.repeat(start[s:e], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    a, b = a[a != b], b[a != b]
                    if len(a):
                        added(lang, ids[a] << 32 | ids[b], f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
            if sum(len(of) for of, _ in sums.values()) >= PAIRS:
                yield from handed()
        yield from handed()

    return rows.select("lang", "ids", "p", "p0").mapInArrow(released(run), "lang string, a long, b long, value long")


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` ranks the other sources of the language by their distance, part `term` the terms that the source uses more than its
    language does, the first `top` of them."""
    kept = stored(index(term_counts(docs, text, lang, source), least), "terms")
    uses = kept.where("term IS NOT NULL").select("lang", "term", "total", F.explode("uses").alias("u")).select("lang", "term", "total", "u.*")
    sizes = kept.groupBy("lang").agg(F.count("term").alias("terms"), F.coalesce(F.sum("total"), F.lit(0)).alias("of_lang"))
    totals = uses.groupBy("lang", "source").agg(F.sum("n").alias("of_source"))
    groups = kept.where("term IS NULL").select("lang", F.explode("uses.source").alias("source"))
    groups = groups.join(totals, ["lang", "source"], "left").join(sizes, "lang").fillna(0, ["of_source"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    nothing = share(F.lit(0).cast("long"), F.col("of_source"), F.col("terms"))
    # a language without kept terms has pairs of value 0, whatever their shares
    groups = stored(groups.withColumns({"id": number, "p0": F.when(F.col("terms") > 0, nothing).otherwise(F.lit(1).cast("long"))}), "sources")
    rated = uses.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("of_source"), F.col("terms")))

    # pairs: the start, the terms of one side, the terms of both
    side = lambda s, *more: groups.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "p0", *more)])
    f = lambda p, q: distance(F.col(p), F.col(q))
    both = side("a").join(side("b", "terms"), "lang").where("id_a <> id_b")
    start = both.select("lang", F.col("id_a").alias("a"), F.col("id_b").alias("b"), (F.col("terms_b") * f("p0_a", "p0_b")).alias("value"))
    alike = stored(rated.groupBy("lang", "id", "p0", "p").agg(F.count("*").alias("m")), "alike")
    one = lambda s: alike.select("lang", F.col("id").alias(f"id_{s}"), F.col("p0").alias(f"p0_{s}"), "p", "m")
    ends = ("lang", F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    near = one("a").join(side("b"), "lang").where("id_a <> id_b").select(*ends, (F.col("m") * (f("p", "p0_b") - f("p0_a", "p0_b"))).alias("value"))
    far = one("b").join(side("a"), "lang").where("id_a <> id_b").select(*ends, (F.col("m") * (f("p0_a", "p") - f("p0_a", "p0_b"))).alias("value"))
    listed = rated.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("id", "p", "p0"))).alias("u"))
    met = shared_terms(listed.select("lang", *[F.col(f"u.{x}").alias(y) for x, y in (("id", "ids"), ("p", "p"), ("p0", "p0"))]))
    value = start.union(near).union(far).union(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda s, c: groups.select("lang", F.col("id").alias(s), F.col("source").alias(c))
    pairs = value.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])

    # terms
    q = share(F.col("total"), F.col("of_lang"), F.col("terms"))
    marked = rated.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), f("p", "q").alias("value"))
    ranks = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", ranks.alias("rank"))
    return out(pairs, "pair").union(out(marked, "term").where(F.col("rank") <= top))


def query(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


def _sql() -> str:
    share = lambda n, total: f"(1 + ({SCALE}::hugeint * ({n} + 1)) // ({total} + v))"
    far = lambda p, q: f"((({p} - {q}) * ({p} - {q})) // {q})"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () id, coalesce(text, '') t, coalesce(lang, '') lang, coalesce(source, '') source FROM documents),
words AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
groups_ AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
uses AS MATERIALIZED (SELECT lang, source, term, count(*) n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) v FROM kept GROUP BY ALL),
of_source AS (SELECT lang, source, coalesce(sum(n), 0) n_all FROM groups_ LEFT JOIN uses USING (lang, source) GROUP BY ALL),
of_lang AS (SELECT lang, sum(n) n_all FROM uses GROUP BY ALL),
full_ AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) n, {share("coalesce(u.n, 0)", "s.n_all")} p
  FROM groups_ g JOIN kept k USING (lang) JOIN sizes USING (lang) JOIN of_source s ON s.lang = g.lang AND s.source = g.source LEFT JOIN uses u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
whole AS (SELECT lang, term, {share("sum(n)", "any_value(o.n_all)")} q FROM uses JOIN of_lang o USING (lang) JOIN sizes USING (lang) GROUP BY lang, term, v),
summed AS (SELECT a.lang, a.source, b.source item, sum({far("a.p", "b.p")}) s FROM full_ a JOIN full_ b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source item, coalesce(s, 0) s FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term item, {far("p", "q")} s FROM full_ JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
both_ AS (SELECT 'pair' part, * FROM pairs UNION ALL SELECT 'term', * FROM terms)
SELECT lang, source, part, item, s::bigint AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY s DESC, item))::int AS rank FROM both_
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY s DESC, item) <= {TOP}"""


SQL = _sql()
