"""Links of candidate groups, confirmed on the full sets of word shingles.

The near-duplicate operators find candidates by fingerprints; this gives the exact links among them. A
class is what texts of equal shingle sets are. One document of each class is read again where its
candidate group has several classes. Their sets are dealt by group, groups of more than a cell as pairs
of chunks, very large ones by bucket first. In a task, links spread breadth first over an inverted
index of the shingles; it gives spanning stars, never all pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts_of, written

#: Classes and shingles of a cell, what one task compares at a time.
CELL, CELL_SHINGLES = 4096, 4_000_000


def digest(hashes: np.ndarray) -> bytes:
    """The name of a class: 128 bits of its set (uint64, ascending)."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def spanning_links(sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Edges (member, root), as positions in sets, that join the components of sets whose
    intersection is at least `percent` % of their union. Breadth first: what has been reached isn't
    compared again. Intersections are counted through the lists of sets that hold a shingle."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    end = np.cumsum(size)
    _, term = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(len(sets)), size)[np.argsort(term, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(term))))
    left = np.ones(len(sets), bool)
    members, roots = [], []

    def linked(i: int) -> np.ndarray:
        mine = term[end[i] - size[i] : end[i]]
        lists = [holders[a:b] for a, b in zip(first[mine].tolist(), first[mine + 1].tolist(), strict=True) if b - a > 1]
        if not lists:
            return np.zeros(0, np.int64)
        common = np.bincount(np.concatenate(lists), minlength=len(sets))
        return np.flatnonzero(left & (100 * common >= percent * (size + size[i] - common)))

    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            found = linked(front.pop())
            left[found] = False
            members += found.tolist()
            roots += [root] * len(found)
            front += found.tolist()
    return members, roots


def _confirmed(batches, percent: int):
    """Arrow batches of (key, a, b, digest, hashes) sorted by the first four into edges (u, v) of
    digests. One cell is held at a time; rows that repeat a digest within it count once."""
    held: dict[bytes, np.ndarray] = {}
    at = None

    def edges():
        names = list(held)
        u, v = spanning_links(list(held.values()), percent) if len(names) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array([names[i] for i in u], pa.binary()), pa.array([names[i] for i in v], pa.binary())], names=["u", "v"])

    for batch in batches:
        key, a, b = (c.to_pylist() for c in batch.columns[:3])
        for i, cell in enumerate(zip(key, a, b, strict=True)):
            if cell != at:
                if held:
                    yield edges()
                held, at = {}, cell
            held[batch.column(3)[i].as_py()] = np.frombuffer(batch.column(4)[i].as_py(), np.uint64)
    if held:
        yield edges()


def _by_buckets(rows: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """key, digest, hashes: rows once for each bucket of their set."""

    @F.arrow_udf("array<bigint>")
    def keys(hashes: pa.Array) -> pa.Array:
        return pa.array([keys_of(np.frombuffer(h.as_py(), np.uint64)) for h in hashes], pa.list_(pa.int64()))

    return rows.select(F.explode(keys(F.col("hashes"))).alias("key"), "digest", "hashes")


def _dealt(rows: DataFrame, several: bool, keys_of: Callable, bands: int, cell: int, cell_shingles: int) -> DataFrame:
    """key, a, b, digest, hashes of rows (root, chunks, digest, hashes): once for each pair of chunks
    that they are in. Where `several` says that there are roots of more chunks than bands, those are
    dealt by their buckets first, as all candidates meet in one of these too, and the buckets as pairs
    of chunks by their own size."""
    dealt = rows.where(F.col("chunks") <= bands).select(F.xxhash64("root").alias("key"), "chunks", "digest", "hashes")
    if several:
        spread = _by_buckets(written(rows.where(F.col("chunks") > bands), "confirm-sets"), keys_of)
        n = spread.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("hashes") / 8).alias("total")).where("n > 1")
        n = written(n.select("key", _chunks("n", "total", cell, cell_shingles)), "confirm-buckets")
        dealt = dealt.unionByName(spread.join(n, "key"))
    chunk = F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return dealt.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "digest", "hashes")


def _chunks(n: str, total: str, cell: int, cell_shingles: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / cell), F.ceil(F.col(total) / cell_shingles)).cast("int").alias("chunks")


def classes_of(sig: DataFrame) -> DataFrame:
    """digest, n, fp, keys and best, the row of the smallest doc_id (null last; ties by the hash of the
    text), of every class of sig (doc_id, text_hash, n, digest, fp, keys)."""
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))
    return sig.groupBy("digest").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), smallest.alias("best"))


def confirmed(docs: DataFrame, classes: DataFrame, roots: DataFrame, set_of: Callable, keys_of: Callable, bands: int, percent: int, cell: int = CELL, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """u, v: digests joined by links of at least `percent` % similarity within candidate groups:
    classes (digest, n, fp, best) whose fingerprints have one root in roots (u, v; a fingerprint
    that isn't there is its own). set_of gives the set of a text, keys_of the buckets of a set."""
    prints = classes.groupBy("fp").agg(F.count("*").alias("n"), F.sum("n").alias("total"))
    named = prints.join(roots, F.col("fp") == F.col("u"), "left").select(F.col("fp").alias("g_fp"), F.coalesce("v", "fp").alias("root"), "n", "total")
    named = written(named, "confirm-named")
    groups = named.groupBy(F.col("root").alias("g_root")).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 1")
    groups = written(groups.select("g_root", _chunks("n", "total", cell, cell_shingles)), "confirm-groups")
    held = named.join(groups, F.col("root") == F.col("g_root")).select("g_fp", "root", "chunks")
    held = classes.join(held, F.col("fp") == F.col("g_fp")).select("root", "chunks", "digest", F.col("best.doc_id").alias("h_id"), F.col("best.text_hash").alias("h_hash"))
    held = written(held, "confirm-held")

    @F.arrow_udf("binary")
    def hashes(text: pa.Array) -> pa.Array:
        return pa.array([set_of(t).tobytes() for part in texts_of(text) for t in part], pa.binary())

    # held grows with the corpus, so it is never broadcast; each task builds a table of its own share
    texts = docs.select("doc_id", "text").join(held.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.xxhash64("text") == F.col("h_hash")))
    sets = texts.select("root", "chunks", "digest", hashes(F.col("text")).alias("hashes"))
    several = bool(groups.where(F.col("chunks") > bands).limit(1).count())
    dealt = _dealt(sets, several, keys_of, bands, cell, cell_shingles)
    dealt = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "digest")
    return dealt.mapInArrow(lambda batches: _confirmed(batches, percent), "u binary, v binary").distinct()
