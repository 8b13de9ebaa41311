"""A corpus pipeline: documents in, packed training sequences out.

quality    documents that the line field, fitted on labels, scores under one half go
duplicates one document of each group of near duplicates stays
secrets    found secrets are masked in the text
mix        documents are repeated or left out so that sources come to their target shares
pack       texts are encoded, cut and packed into sequences

Each stage takes all that the one before kept. All but the last return the columns of documents; n_chars follows the
text. Null and empty texts, repeated rows and empty tables are treated as each operator says. Further columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import mix_budget, ngram_join, pack_ga, quality_crf, secret_scan
from tilewright.llm.common import fresh, plain, stored, table

#: Stages beyond SQL: the fit of a field, a search over bytes, a vocabulary test and a packing.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(quality_crf.fold(F.col("doc_id"), 3) != 1)
    field = quality_crf.fit(docs, labels)
    (score,) = fresh(docs, "score")
    return quality_crf.score(docs, field, out=score).where(F.col(score) >= 0.5).drop(score)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by all their columns, not by doc_id, which may be null or repeated; rows alike in every column stand for each other."""
    one, two, copies, rows = fresh(docs, "one", "two", "copies", "rows")
    named = docs.withColumns({c: F.xxhash64(F.lit(i), *[F.col(plain(n)) for n in docs.columns]) for i, c in enumerate((one, two))})
    sizes = stored(named.select(F.col(one).alias("one"), F.col(two).alias("two"), "source", mix_budget.word_count(F.col("text")).alias("size")), "sizes")
    taken = mix_budget.mix(sizes, key=("one", "two")).groupBy("one", "two").agg(F.sum("copies").alias(copies), F.count("*").alias(rows))
    taken = stored(taken.where(F.col(copies) > 0).select(F.col("one").alias(f"{one}_"), F.col("two").alias(f"{two}_"), copies, rows), "taken")
    full = named.join(taken, (F.col(one) == F.col(f"{one}_")) & (F.col(two) == F.col(f"{two}_")))
    each = F.floor(F.col(copies) / F.col(rows)).cast("int")
    times = lambda d, n: d.withColumn(copies, F.explode(F.array_repeat(F.lit(0), n))).select([F.col(plain(c)) for c in docs.columns])
    if taken.where(F.col(rows) > 1).isEmpty():
        return times(full, F.col(copies).cast("int"))
    rest = full.where(F.col(copies) % F.col(rows) > 0).dropDuplicates([one, two])
    return times(full, each).union(times(rest, (F.col(copies) % F.col(rows)).cast("int")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_ga.pack(stored(pack_ga.pieces(docs), "pieces"))


STAGES = [("quality", quality), ("duplicates", duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
