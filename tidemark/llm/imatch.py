"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon is every term within a band of document frequency. A text's distinct lexicon terms,
sorted, are hashed once for the whole lexicon and once for each of 64 random subsets of it, from a
thirty-second down to a 256th: a part survives an edit if no term of its subset comes or goes, so
small subsets tell how much was edited and the whole lexicon whether anything was. Two fingerprints
are alike by the share of equal parts among those that aren't empty in both.

Scale: document frequencies of all terms are counted over all texts; tasks combine the counts of
their documents before the shuffle. A lexicon term occurs in at least `low` of all documents, so
the broadcast lexicon has at most (terms per document) / low entries. To pair each document with
the next one, texts are shuffled once, in ranges of doc_id and a hash of the text, so that rows of
one doc_id are spread; the first row of a range is also sent to the range before."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import code_points, mix64, texts_of, written

#: Subsets of the lexicon by rate; the first is all of it.
RATES = [1.0] + [1 / 32] * 4 + [1 / 64] * 12 + [1 / 128] * 24 + [1 / 256] * 24
#: Terms that a task holds at most before it combines their counts, beyond those of one text.
HELD = 1 << 22
EMPTY = "0" * 8
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_ASCII = np.zeros(128, np.uint32)
for _c in range(128):
    if chr(_c).isalnum():
        _ASCII[_c] = ord(chr(_c).lower())


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, as far as a text needs."""
    if len(_powers[0]) < n:
        for t, b in enumerate((_BASE, _INVERSE)):
            step = np.full(max(n, 1 << 16), b, np.uint64)
            step[0] = 1
            _powers[t] = np.cumprod(step, dtype=np.uint64)
    return _powers


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's terms: runs of ASCII letters and digits, A-Z
    lower-cased, and of any character beyond ASCII."""
    if not text:
        return np.zeros(0, np.uint64)
    c = code_points(text)
    low = np.minimum(c, 127)
    c = np.where(c < 128, _ASCII[low], c)
    on = c != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(c) + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(c.astype(np.uint64) * power[: len(c)], dtype=np.uint64)))
    h = (total[end] - total[start]) * inverse[start]
    return np.unique(mix64(h ^ (end - start).astype(np.uint64)))


def subset_bits(lexicon: np.ndarray) -> np.ndarray:
    """Bool [terms, subsets]: which subsets a lexicon term is in."""
    coin = [mix64(mix64(lexicon) + np.uint64(1000 + j)) / float(1 << 64) < rate for j, rate in enumerate(RATES)]
    return np.stack(coin, axis=1) if len(lexicon) else np.zeros((0, len(RATES)), bool)


def fingerprint(text: str | None, lexicon: np.ndarray, bits: np.ndarray) -> list[str]:
    """Eight hex digits for each subset; an empty subset gives zeros. A text without a lexicon
    term is told apart by all its terms, in the first part."""
    own = terms(text)
    at = np.searchsorted(lexicon, own)
    at = at[(at < len(lexicon)) & (lexicon[np.minimum(at, len(lexicon) - 1)] == own)] if len(lexicon) else at[:0]
    if not len(at):
        return [hashlib.blake2b(b"all" + own.tobytes(), digest_size=4).hexdigest(), *[EMPTY] * (len(RATES) - 1)]
    own, member = lexicon[at], bits[at]
    parts = [own[member[:, j]] for j in range(len(RATES))]
    return [hashlib.blake2b(p.tobytes(), digest_size=4).hexdigest() if len(p) else EMPTY for p in parts]


def likeness(a: list[str], b: list[str]) -> float:
    """Share of equal parts among those that aren't empty in both."""
    both = [(x, y) for x, y in zip(a, b, strict=True) if x != EMPTY or y != EMPTY]
    return sum(x == y for x, y in both) / len(both) if both else 1.0


def _count(batches, chunk: int):
    """Document frequencies of terms, combined over `chunk` documents at a time, or HELD terms."""
    held: list[np.ndarray] = []
    size = 0

    def out():
        t, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n, pa.int64())], names=["term", "n"])

    for batch in batches:
        for text in (t for part in texts_of(batch.column(0)) for t in part):
            held.append(terms(text))
            size += len(held[-1])
            if len(held) >= chunk or size >= HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def lexicon(docs: DataFrame, low: float = 0.005, high: float = 0.5, chunk: int = 4096) -> np.ndarray:
    """Sorted hashes of lexicon terms found in at least low and at most high of all documents,
    and in two at least. Counts cover every text."""
    counts = docs.select("text").mapInArrow(lambda b: _count(b, chunk), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))
    n = docs.select(F.lit(1)).count()
    kept = counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term").toArrow()
    return np.sort(kept["term"].to_numpy().view(np.uint64))


def _pairs(batches, sent, id_type: pa.DataType):
    """Rows in order, each with the one after it. A row with copy = 1 closes its range."""
    words, bits = sent.value
    schema = pa.schema([("doc_id", id_type), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held, closed = None, None
    for batch in batches:
        rows = []
        for row in range(batch.num_rows):  # one text in memory at a time
            where, copy, doc_id, text = (c[row].as_py() for c in batch.columns)
            if copy and closed == where:
                continue
            text = text or ""
            own = fingerprint(text, words, bits)
            if held is not None:
                h_id, h_text, h_own = held
                half = len(h_text) // 2
                edited = h_text[: len(h_text) - half] + text[:half]
                changed = fingerprint(edited, words, bits)
                rows.append((h_id, len(h_text), hashlib.sha256(edited.encode()).hexdigest(), "".join(h_own), "".join(changed), likeness(h_own, changed), likeness(h_own, own)))
            held, closed = (None, where) if copy else ((doc_id, text, own), closed)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def with_next(docs: DataFrame, low: float = 0.005, high: float = 0.5) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for
    every row of docs (doc_id, text), the next document being that of the next smaller doc_id,
    after the last the first.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next text. A null text is empty; a null doc_id comes last; rows that repeat a doc_id are
    ordered by a hash of the text, then the text, and are each other's next. A single row is its own next. An empty table gives
    an empty result. Other columns are not read."""
    spark = docs.sparkSession
    words = lexicon(docs, low, high)
    sent = spark.sparkContext.broadcast((words, subset_bits(words)))
    id_field = docs.schema["doc_id"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the order of documents, turned round: null first, then ascending, with ties by a falling hash
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.bitwise_not(F.xxhash64(F.coalesce("text", F.lit("")))).alias("tie"))
    keys = docs.select(place.alias("at")).repartitionByRange(tasks * 4, "at")
    ranges = written(keys.groupBy(F.spark_partition_id().alias("p")).agg(F.max("at").alias("top")), "imatch-ranges")
    tops = sorted(((r["top"]["known"], r["top"]["doc_id"] if r["top"]["known"] else 0, r["top"]["tie"]) for r in ranges.collect()))  # one a range
    n = len(tops)

    @F.arrow_udf("struct<range:int,head:boolean>")
    def range_of(doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        rows = [(i is not None, 0 if i is None else i, t) for i, t in zip(doc_id.to_pylist(), tie.to_pylist(), strict=True)]
        at = [min(bisect.bisect_left(tops, r), n - 1) for r in rows]
        return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array([tops[a] == r for a, r in zip(at, rows, strict=True)], pa.bool_())], names=["range", "head"])

    # ranges ascend, documents descend: after the last row of range r comes the top of range r - 1
    base = docs.select("doc_id", "text", F.bitwise_not(F.xxhash64(F.coalesce("text", F.lit("")))).alias("tie"))
    base = base.select("*", range_of("doc_id", "tie").alias("own"))
    own = F.struct(F.col("own.range").alias("range"), F.lit(0).alias("copy"))
    above = F.when(F.col("own.range") == n - 1, F.lit(0)).otherwise(F.col("own.range") + 1)
    places = F.when(F.col("own.head"), F.array(own, F.struct(above.cast("int").alias("range"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = base.select("doc_id", "tie", "text", F.explode(places).alias("at")).select("at.range", "at.copy", "doc_id", "tie", "text")
    dealt = dealt.repartition(tasks, "range").sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), "text").drop("tie")
    out = StructType([StructField("doc_id", id_field.dataType), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType())])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _pairs(batches, sent, to_arrow_type(id_field.dataType))

    return dealt.mapInArrow(run, out)
