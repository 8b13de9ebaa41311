"""Secret scan: fixed patterns, and strings that a public vocabulary encodes badly.

Base spans are the leftmost non-overlapping matches of three patterns. Beside them, long runs of
[A-Za-z0-9+/_=-] are encoded with a byte-pair vocabulary: natural text takes several characters a token,
random strings under `ratio`. Known digests and identifiers (hex of a digest's length, UUIDs, numbers) and base spans are cut out of
a run first; what is left and long enough is measured whole, and else its parts between the marks `/ _ = + -`. Words in capitals
are measured in small letters too, as the vocabulary knows few capital ones. Nothing else is left out: slugs and names have to pass by their ratio.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are scanned one by
one. Texts of any length are scanned whole. Spans that start together come in the order of KINDS. A column of the name of the output, whatever its case, is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import mapped, place, table
from .text import runs, slices

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: A known identifier, or a digest or number that is a part of its own.
KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{UUID}|[0-9]+|[0-9a-f]+|[0-9A-F]+)(?![A-Za-z0-9])")
PART = re.compile(r"[A-Za-z0-9]+")
LEAST = 20
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


class Ratio:
    """Characters a token."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, s: str) -> float:
        ratio = len(s) / max(1, len(self.encoding.encode_ordinary(s)))
        return ratio if s.upper() != s or s.isdigit() else max(ratio, len(s) / max(1, len(self.encoding.encode_ordinary(s.lower()))))


def known(s: str) -> list[tuple[int, int]]:
    """Where digests and identifiers are in a run."""
    return [m.span() for m in KNOWN.finditer(s) if "-" in m[0] or m[0].isdigit() or m.end() - m.start() in DIGESTS]


def base_spans(text: str, run: bool = True) -> list[tuple[int, int, str]]:
    """Spans of the three patterns. `run` False: the text has no run that the last two could match."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if run:
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def token_spans(text: str, base: list[tuple[int, int, str]], ratio: Ratio, most: float) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][1] <= m.start():
            at += 1
        cuts = [(m.start() + a, m.start() + b) for a, b in known(m[0])]
        i = at
        while i < len(base) and base[i][0] < m.end():
            cuts.append(base[i][:2])
            i += 1
        start = m.start()
        for a, b in [*sorted(cuts), (m.end(), m.end())]:
            if a - start >= LEAST:
                if ratio(text[start:a]) < most:
                    out.append((start, a, "token"))
                else:
                    out += [(p.start(), p.end(), "token") for p in PART.finditer(text, start, a) if LEAST <= p.end() - p.start() < a - start and ratio(p[0]) < most]
            start = max(start, b)
    return out


def _rows_with_runs(column: pa.Array, least: int) -> np.ndarray:
    """Whether each row has a run of at least `least` characters of the alphabet."""
    out = np.zeros(len(column), bool)
    for first, _, data, offsets in slices(column):
        starts, ends, row = runs(_RUN[data], offsets)
        out[first + row[ends - starts >= least]] = True
    return out


def _found(texts: pa.Array, measure: Ratio, most: float) -> Iterator[tuple[str | None, list[tuple[int, int, str]]]]:
    """Text and spans of each row."""
    for i, long in enumerate(_rows_with_runs(texts, LEAST).tolist()):
        s = texts[i].as_py()
        spans = base_spans(s or "", long)
        if long:
            spans = sorted(spans + token_spans(s, spans, measure, most), key=lambda x: (x[0], KINDS.index(x[2])))
        yield s, spans


def scan(df: DataFrame, text: str = "text", out: str = "secrets", ratio: float = 2.0, vocabulary: str | None = None) -> DataFrame:
    """Add an array of (kind, start, end), by start and then kind, to df."""
    at = place(df, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        measure = Ratio(vocabulary)
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for _, spans in _found(batch.column(at), measure, ratio)]
            yield batch, [pa.array(found, kind)]

    return mapped(df, run, StructType([StructField(out, SPANS)]))


def masked(s: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with the mark in place of every span; overlapping spans get one mark."""
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [s[at:a], mark]
        at = max(at, b)
    return "".join([*parts, s[at:]])


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", ratio: float = 2.0, vocabulary: str | None = None) -> DataFrame:
    """df with a mark in place of every found span of the text."""
    at = place(df, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        measure = Ratio(vocabulary)
        for batch in batches:
            own = batch.column(at)
            yield batch, [pa.array([masked(s, spans, mark) if spans else s for s, spans in _found(own, measure, ratio)], own.type)]

    return mapped(df, run, StructType([df.schema[at]]), in_place=True)


def query(spark, sf_dir):
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    base = F.concat_ws(",", F.transform(F.filter("secrets", lambda x: x["kind"] != "token"), one))
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("secrets", one)).alias("spans"),
    )
