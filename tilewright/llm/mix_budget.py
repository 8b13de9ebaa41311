"""Mixing sources to target weights, to the word, by subset sums.

Each source gets a budget of words: its share by weight, at most `most` times what it has, the excess dealt
again by weight. Whole rounds of the source come first; for the rest of the budget, documents are counted by
exact length, an equal part of each length is taken, and a bounded-knapsack table over lengths fits what is
left as closely as counts allow. Which documents of a length are taken is decided by a seeded hash, so reruns
agree. A source is one row per distinct length by then, whatever its size.

Null source is a source of its own and comes last; null and empty texts have size 0 and take nothing.
Repeated rows are documents of their own. An empty table gives an empty result. A source of size 0 has target 0. Documents of one length are
ties: the seeded hash of their keys decides. Columns source_size, target and copies of the input are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, ranked, stored, table

WEIGHTS = (3, 1, 2)
#: Words kept back from the even part, so that the table has small lengths to choose from; more where that misses the budget.
SLACK = (1 << 12, 1 << 16, 1 << 20)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame) -> DataFrame:
    """Add `place`, from 0, of each row in the order of source, null last. Rows are dealt by ranges; what the driver gets is a count a range."""
    rows = sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    rows = stored(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")  # the part in the upper bits, the place in it below
    part, at, before = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)), 0
    starts = []
    for r in sorted(rows.groupBy(part.alias("part")).count().collect()):
        starts += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*starts), part) if starts else F.lit(0)
    return rows.withColumn("place", (start + at).cast("long")).drop("id")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add target to sources (source, source_size; one row each): min(most * size, level * weight), where the level
    uses up share * all sizes. The level rises from round to round as the excess of full sources is dealt again; a round is one sum over all sources."""
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = numbered(sources).withColumn("w", F.element_at(listed, (F.pmod("place", F.lit(len(weights))) + 1).cast("int")))
    rows = stored(rows.withColumn("cap", most * F.col("source_size")), "weights")
    every = share * (rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("w")
        n, spent, w = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == full or not w:
            break
        level, full = (every - spent) / w, n
    return rows.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w") if w else F.col("cap")).alias("target"))


def fit(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that the total comes as close to the budget as it can, at most count each. Lengths descend."""
    miss = lambda took: abs(budget - sum(n * k for n, k in zip(lengths, took, strict=True)))
    total, best = sum(n * c for n, c in zip(lengths, counts, strict=True)), None
    budget = max(0, min(budget, total))
    for slack in SLACK:
        took = _fit(lengths, counts, budget, slack)
        best = took if best is None or miss(took) < miss(best) else best
        if not miss(best) or slack >= total:
            break
    return best


def _fit(lengths: Sequence[int], counts: Sequence[int], budget: int, slack: int) -> list[int]:
    """An even part of each length is taken with the remainder carried on to the next; `slack` words of
    small ones are given back; a bounded-knapsack table (one bit set per reachable sum) fits the rest."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    part = budget / total if total else 0.0
    took, carry = [], 0.0
    for n, c in zip(lengths, counts, strict=True):
        want = c * n * part + carry
        k = min(c, max(0, int(want / n))) if n else 0
        took.append(k)
        carry = want - k * n
    left = budget - sum(n * k for n, k in zip(lengths, took, strict=True))
    for i in range(len(lengths) - 1, -1, -1):
        if left >= slack:
            break
        n = lengths[i]
        if n:
            give = min(took[i], -(-(slack - left) // n), max(1, slack // (8 * n)))
            took[i] -= give
            left += give * n
    i = 0
    while left < 0:  # rounding went over: give back the longest
        if took[i] and lengths[i]:
            took[i] -= 1
            left += lengths[i]
        else:
            i += 1
    usable = [i for i in range(len(lengths) - 1, -1, -1) if lengths[i] and counts[i] > took[i]]
    # a sum past the budget may come nearer than any below; without any below, the least length does
    top = left + max(min(left, lengths[usable[-1]]), lengths[usable[0]]) if usable else left
    keep = (1 << (top + 1)) - 1
    reach, tables = 1, []
    for i in usable:
        n, free = lengths[i], min(counts[i] - took[i], top // lengths[i])
        if not free:
            continue
        tables.append((i, free, reach))
        step = 1
        while free:  # binary pieces of a bounded count
            k = min(step, free)
            reach |= (reach << (k * n)) & keep
            free -= k
            step *= 2
        if reach >> left & 1:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> (left + 1)
    sum_ = below
    if above:
        over = left + 1 + (above & -above).bit_length() - 1
        sum_ = over if over - left < left - below else below
    for i, free, before in reversed(tables):
        k = 0
        while not before >> (sum_ - k * lengths[i]) & 1:
            k += 1
        took[i] += k
        sum_ -= k * lengths[i]
    return took


def _fitted(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ascending=False)
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = int(target // size) if size else 0
    rows["extra"] = fit(rows["size"].tolist(), rows["n"].tolist(), round(target - whole * size))
    rows["whole"] = whole
    return rows[["source", "size", "source_size", "target", "whole", "extra"]]


def mix(docs: DataFrame, size: str = "size", source: str = "source", key: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """Add source_size, target and copies (how often the document is taken) to docs, which must have `size`. docs is read several times: store it first."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("source_size", "target", "copies")])
    of, n, rank, s, z, whole, extra = fresh(docs, "source", "size", "rank", "of", "length", "whole", "extra")
    rows = docs.withColumns({of: F.col(source), n: F.coalesce(F.col(size).cast("long"), F.lit(0))})
    counts = stored(rows.groupBy(F.col(of).alias("source"), F.col(n).alias("size")).agg(F.count("*").alias("n")), "mix-lengths")
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aimed = targets(sources, weights, share, most).withColumnRenamed("source", "_s")
    per = counts.join(aimed, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    kind = docs.schema[source].dataType.simpleString()
    plan = stored(per.groupBy("source").applyInPandas(_fitted, f"source {kind}, size long, source_size long, target double, whole int, extra long"), "mix-plan")
    plan = plan.select(F.col("source").alias(s), F.col("size").alias(z), "source_size", "target", F.col("whole").alias(whole), F.col("extra").alias(extra))
    # the plan has a row for each source and length, which no bound limits: it is shuffled, not sent to every task
    out = ranked(rows, [of, n], list(key), seed, rank).join(plan.hint("merge"), F.col(of).eqNullSafe(F.col(s)) & (F.col(n) == F.col(z)), "left")
    copies = (F.col(whole) + (F.col(rank) <= F.col(extra)).cast("int")).cast("int")
    return out.withColumn("copies", F.when(F.col(n) > 0, copies).otherwise(0)).drop(of, n, rank, s, z, whole, extra)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(stored(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
