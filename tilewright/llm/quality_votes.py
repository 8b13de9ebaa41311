"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how accurate they are, the posterior decides.

Only DataFrame functions run here. A text's measures come from its own row, in arrays. Each rule turns them into a vote for good (1) or bad (0) or abstains (null). Votes are independent
given the document's quality; of a rule, `good` is the share of votes for good among good documents, `bad` that of votes for bad among bad ones. Documents with
equal votes are counted together, so what the estimate sees has at most 3 to the power of the number of rules rows, whatever the
size of the corpus; it runs as one expression over that list. Counts cover all documents.

Null and empty texts have no words: all measures are 0, they fail the base test and only the rule of length votes. Repeated rows count and are judged one by one. Texts of any
length are measured whole; a row needs memory for its words. A tie, posterior equal to the limit, keeps. Empty tables give empty results. Columns of the names of
the outputs, whatever their case, are replaced; others stay. Two windows of words count as equal when their 64-bit hashes in one text are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, plain, stored, table

SPACE = r"[\x20\x09-\x0D]+"
WIDTH = 8
#: Share of good documents, and each rule's accuracies, that the estimate starts from and that weigh as many documents as PRIOR says.
START, PRIOR = (0.8, 0.95, 0.4), 10.0
ROUNDS, LIMIT = 25, 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = (*BASE, "n_lines", "n_distinct_words", "n_capitals", "n_digits", "n_ends", "n_odd_words", "n_plain_words")
#: Words with a symbol in them; words of letters alone, but for one mark at the end.
ODD, PLAIN_WORD = r"[#*$%&|<>]", r"^\p{L}+[.,;:?!]?$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeat_words(words: Column, width: int = WIDTH) -> Column:
    """Words that lie in a window of `width` words found twice or more in the text."""

    def covered(hashes: Column) -> Column:
        def spread(pairs: Column) -> Column:
            as_at = lambda x, i: F.coalesce(x["h"] == F.get(pairs, i)["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(pairs, lambda x, i: as_at(x, i - 1) | as_at(x, i + 1)), lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
            new = lambda a, p: F.struct((a["n"] + width - F.greatest(a["end"] - p, F.lit(0))).alias("n"), (p + width).alias("end"))
            return F.aggregate(at, start, new, lambda a: a["n"])

        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(some, once(pairs, spread)).otherwise(F.lit(0).cast("long"))

    def windows(each: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(each) - (width - 1)), lambda i: F.xxhash64(F.slice(each, i, width)))

    long_enough = F.size(words) > width
    return F.when(long_enough, once(once(F.transform(words, lambda w: F.xxhash64(w)), windows), covered)).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of MEASURES, longs, of a text."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda signs: F.size(F.split(text, signs, -1)) - 1

    def of_words(w: Column) -> dict[str, Column]:
        like = lambda pattern: F.size(F.filter(w, lambda x: x.rlike(pattern)))
        return {
            "n_words": F.size(w), "word_chars": F.length(F.array_join(w, "")), "n_repeat_words": repeat_words(w), "n_distinct_words": F.size(F.array_distinct(w)),
            "n_odd_words": like(ODD), "n_plain_words": like(PLAIN_WORD),
        }

    def of_lines(x: Column) -> dict[str, Column]:
        return {"n_dup_lines": F.size(x) - F.size(F.array_distinct(x)), "n_lines": F.size(x)}

    signs = {"n_symbols": count(r"[#*$%&|<>]"), "n_capitals": count("[A-Z]"), "n_digits": count("[0-9]"), "n_ends": count("[.!?]")}
    long = lambda d: [v.cast("long").alias(k) for k, v in d.items()]
    whole = lambda w: once(lines, lambda x: F.struct(*long(of_words(w) | of_lines(x) | signs)))
    return once(words, whole)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures of the text to every row."""
    (name,) = fresh(docs, "measures")
    kept = [F.col(plain(c)) for c in docs.columns if c.lower() not in MEASURES]
    # a stage of its own: else every field would be computed from the text again
    rows = docs.select(*[F.col(plain(c)) for c in docs.columns], measures(F.col(plain(text))).alias(name))
    return rows.select(*kept, *[F.col(f"{name}.{m}").alias(m) for m in MEASURES])


@dataclass(frozen=True)
class Rule:
    """good and bad: SQL conditions over the measures; a document that fits neither, or fits both, gets no vote."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        good, bad = (F.coalesce(F.expr(c), F.lit(False)) for c in (self.good, self.bad))
        return F.when(good & ~bad, 1).when(bad & ~good, 0)


#: `n_words > 0` lets a text without words abstain.
RULES = (
    Rule("length", "n_words >= 80", "n_words < 30"),
    Rule("word_size", "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 9 * n_words", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)"),
    Rule("symbols", "n_words > 0 AND 50 * n_symbols < n_words", "n_words > 0 AND 10 * n_symbols > n_words"),
    Rule("odd_words", "n_words > 0 AND 50 * n_odd_words < n_words", "10 * n_odd_words > n_words"),
    Rule("plain_words", "n_words > 0 AND 10 * n_plain_words >= 8 * n_words", "n_words > 0 AND 10 * n_plain_words < 6 * n_words"),
    Rule("lines", "n_lines > 1 AND n_dup_lines = 0", "n_lines > 0 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "n_words > 0 AND 50 * n_repeat_words < n_words", "n_words > 0 AND 5 * n_repeat_words > n_words"),
    Rule("variety", "n_words BETWEEN 20 AND 5000 AND 10 * n_distinct_words > 3 * n_words", "n_words BETWEEN 20 AND 5000 AND 20 * n_distinct_words < n_words"),
    Rule("capitals", "n_words > 0 AND 10 * n_capitals < word_chars", "n_words > 0 AND 10 * n_capitals > 3 * word_chars"),
    Rule("digits", "n_words > 0 AND 20 * n_digits < word_chars", "n_words > 0 AND 5 * n_digits > word_chars"),
    Rule("sentences", "n_words > 0 AND n_words BETWEEN 4 * n_ends AND 60 * n_ends", "n_words > 0 AND (n_words > 200 * (n_ends + 1) OR 2 * n_words < 3 * n_ends)"),
)
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class Model:
    """What the estimate found: the share of good documents and each rule's accuracies on good and on bad ones."""

    rules: tuple[Rule, ...]
    share: float
    good: tuple[float, ...]
    bad: tuple[float, ...]

    def posterior(self) -> Column:
        """The probability that a document with these measures is good."""
        from math import log

        logit = F.lit(log(self.share / (1 - self.share)))
        for rule, g, b in zip(self.rules, self.good, self.bad, strict=True):
            vote = rule.vote()
            logit = logit + F.when(vote == 1, log(g / (1 - b))).when(vote == 0, log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def _estimate(patterns: Column, n_rules: int, rounds: int) -> Column:
    """From a list of (votes: array of 1, 0 or -1 for none; n) to share, good[], bad[] after some rounds."""
    double = lambda x: F.lit(x).cast("double")
    share0, good0, bad0 = START
    each = F.sequence(F.lit(0), F.lit(n_rules - 1))
    state = F.struct(double(share0).alias("share"), F.array_repeat(double(good0), n_rules).alias("good"), F.array_repeat(double(bad0), n_rules).alias("bad"))

    def total(weighted: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(weighted, double(0.0), lambda a, x: a + value(x))

    def step(s: Column, _: Column) -> Column:
        up = F.zip_with(s["good"], s["bad"], lambda g, b: F.log(g / (1 - b)))
        down = F.zip_with(s["good"], s["bad"], lambda g, b: F.log((1 - g) / b))

        def rated(w: Column) -> Column:
            def weighed(p: Column) -> Column:
                terms = F.transform(p["votes"], lambda v, j: F.when(v == 1, F.get(w["up"], j)).when(v == 0, F.get(w["down"], j)).otherwise(double(0.0)))
                logit = F.aggregate(terms, w["prior"], lambda a, x: a + x)
                return once(1 / (1 + F.exp(-logit)), lambda g: F.struct(p["votes"].alias("votes"), (p["n"] * g).alias("good"), (p["n"] * (1 - g)).alias("bad")))

            return F.transform(patterns, weighed)

        def renewed(x: Column) -> Column:
            hits = lambda j, of, right: total(x, lambda p: F.when(F.get(p["votes"], j) == right, p[of]).otherwise(double(0.0)))
            votes = lambda j, of: total(x, lambda p: F.when(F.get(p["votes"], j) >= 0, p[of]).otherwise(double(0.0)))
            good, bad = total(x, lambda p: p["good"]), total(x, lambda p: p["bad"])
            return F.struct(
                ((good + PRIOR * share0) / (good + bad + PRIOR)).alias("share"),
                F.transform(each, lambda j: (hits(j, "good", 1) + PRIOR * good0) / (votes(j, "good") + PRIOR)).alias("good"),
                F.transform(each, lambda j: (hits(j, "bad", 0) + PRIOR * bad0) / (votes(j, "bad") + PRIOR)).alias("bad"),
            )

        weights = F.struct(up.alias("up"), down.alias("down"), F.log(s["share"] / (1 - s["share"])).alias("prior"))
        return once(once(weights, rated), renewed)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, step) if rounds else state


def fit(rows: DataFrame, rules: Sequence[Rule] = RULES, rounds: int = ROUNDS) -> Model:
    """Estimate from all measured rows. One row with 2 * rules + 1 numbers comes to the driver."""
    votes = F.array(*[F.coalesce(r.vote(), F.lit(-1)) for r in rules])
    counts = rows.select(votes.alias("votes")).groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    listed = counts.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    found = listed.select(_estimate(F.col("patterns"), len(rules), rounds).alias("s")).first().s
    return Model(tuple(rules), found.share, tuple(found.good), tuple(found.bad))


def judge(rows: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """Add base_failed, posterior and kept to measured rows."""
    rows = rows.select(*[F.col(plain(c)) for c in rows.columns if c.lower() not in ("base_failed", "posterior", "kept")])
    rows = rows.withColumns({"base_failed": F.expr(BASE_FAILED), "posterior": model.posterior()})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= limit))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = stored(measured(docs).drop("text"), "measures")
    return judge(rows, fit(rows)).select("doc_id", *BASE, "base_failed", "kept")


def _sql() -> str:
    """The same over DuckDB; a round of the estimate is two common tables."""
    n = len(RULES)
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    count = lambda signs: f"len(regexp_extract_all(t, '{signs}'))"
    votes = ", ".join(f"CASE WHEN ({r.good}) AND NOT ({r.bad}) THEN 1 WHEN ({r.bad}) AND NOT ({r.good}) THEN 0 ELSE -1 END v{i}" for i, r in enumerate(RULES))
    vs = ", ".join(f"v{i}" for i in range(n))
    share0, good0, bad0 = START
    steps = [f"m0 AS MATERIALIZED (SELECT {share0}::double share, " + ", ".join(f"{good0}::double g{i}, {bad0}::double b{i}" for i in range(n)) + ")"]
    logit = "ln(share / (1 - share)) + " + " + ".join(f"CASE v{i} WHEN 1 THEN ln(g{i} / (1 - b{i})) WHEN 0 THEN ln((1 - g{i}) / b{i}) ELSE 0 END" for i in range(n))
    over = lambda x, i, v: f"coalesce(sum({x}) FILTER (v{i} {v}), 0)"
    for k in range(ROUNDS):
        steps.append(f"w{k} AS MATERIALIZED (SELECT {vs}, n * p g, n * (1 - p) b FROM (SELECT {vs}, n, 1 / (1 + exp(-({logit}))) p FROM patterns, m{k}))")
        new = ", ".join(f"({over('g', i, '= 1')} + {PRIOR * good0}) / ({over('g', i, '>= 0')} + {PRIOR}) g{i}, ({over('b', i, '= 0')} + {PRIOR * bad0}) / ({over('b', i, '>= 0')} + {PRIOR}) b{i}" for i in range(n))
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT (coalesce(sum(g), 0) + {PRIOR * share0}) / (coalesce(sum(g + b), 0) + {PRIOR}) share, {new} FROM w{k})")
    return rf"""
WITH texts AS (SELECT row_number() OVER () id, doc_id, coalesce(text, '') t FROM documents),
split AS MATERIALIZED (SELECT id, doc_id, t, {words} w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM texts),
windows AS (SELECT id, i, array_to_string(w[i : i + {WIDTH - 1}], ' ') k FROM split, unnest(range(1, len(w) - {WIDTH - 2})) u(i)),
twice AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, k) > 1),
repeats AS (SELECT id, sum(least({WIDTH}, after - i))::bigint n FROM (SELECT id, i, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i), i + {WIDTH}) after FROM twice) GROUP BY id),
rows_ AS MATERIALIZED (SELECT id, doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, {count("[#*$%&|<>]")} n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
  coalesce(r.n, 0) n_repeat_words, len(l) n_lines, len(list_distinct(w)) n_distinct_words, {count("[A-Z]")} n_capitals, {count("[0-9]")} n_digits, {count("[.!?]")} n_ends,
  len(list_filter(w, lambda x: regexp_matches(x, '{ODD}'))) n_odd_words, len(list_filter(w, lambda x: regexp_matches(x, '{PLAIN_WORD}'))) n_plain_words
  FROM split LEFT JOIN repeats r USING (id)),
voted AS MATERIALIZED (SELECT *, {votes} FROM rows_),
patterns AS MATERIALIZED (SELECT {vs}, count(*)::double n FROM voted GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, {", ".join(f"{b}::bigint {b}" for b in BASE)}, ({BASE_FAILED}) base_failed, NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({logit}))) >= {LIMIT} kept FROM voted, m{ROUNDS}"""


SQL = _sql()
