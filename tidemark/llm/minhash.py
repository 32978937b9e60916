"""MinHash near-duplicates with min-max hashing.

A document is the set of its word shingles. Each of `PERMUTATIONS` permutations of the shingle
hashes gives two values, its least and its greatest, so half the hash evaluations fill a signature;
either value of two documents is equal with a probability of their Jaccard similarity. Bands of
`ROWS` values are bucket keys: two documents of similarity 0.8 share none of the `BANDS` buckets with
a probability of 5e-8. Every link is confirmed on the full sets.

1. Documents of equal sets are one class (a digest of the sorted set).
2. Classes that share a bucket and differ in at most `RADIUS` of the 128 lowest bits of their
   signatures are candidates (at similarity 0.8 13 bits differ on average; over 32 with a probability
   of 1e-7). They are compared as bit planes and joined to candidate groups, which also fall apart
   where documents only share a passage.
3. Links are confirmed within candidate groups on the full sets (see confirm.py).
4. Components of the confirmed links.

Scale: signatures take 0.4 kB a class, and the sets that are shuffled are those of candidates. Tables
between steps are written to the shared folder, so a lost executor costs one step."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix64, texts_of, written
from .confirm import CELL, CELL_SHINGLES, classes_of, confirmed, digest
from .simhash import compare, components, shingle_hashes

#: Permutations, values of a band, bands, differing lowest bits of candidates.
PERMUTATIONS, ROWS, BANDS, RADIUS = 64, 4, 32, 32
#: Shingles that are turned at a time.
TURNED = 4096

_FACTORS = (mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct hashes (uint64, ascending) of the runs of k words, or of all words of a shorter text."""
    return np.unique(shingle_hashes(text, k))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least and greatest value (uint32) of a set under each permutation, least ones first."""
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    greatest = np.zeros(PERMUTATIONS, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), TURNED):
        turned = _FACTORS[:, None] * short[a : a + TURNED]
        least = np.minimum(least, turned.min(axis=1))
        greatest = np.maximum(greatest, turned.max(axis=1))
    return np.concatenate((least, greatest))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key (int64) for each band of a signature."""
    key = np.arange(BANDS, dtype=np.uint64)
    for row in sig.reshape(ROWS, BANDS):
        key = mix64(key * _STEP + row)
    return key.view(np.int64)


def low_bits(sig: np.ndarray) -> bytes:
    return np.packbits((mix64(sig.astype(np.uint64)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes()


def described(text: Column, k: int) -> Column:
    """n (size of the set), digest, fp (the lowest bits) and keys of a text; the last three are null
    for a text without words."""

    @F.arrow_udf("struct<n:bigint,digest:binary,fp:binary,keys:array<bigint>>")
    def describe(text: pa.Array) -> pa.Array:
        n, digests, fps, keys = [], [], [], []
        for part in texts_of(text):
            for t in part:
                h = shingle_set(t, k)
                n.append(len(h))
                if not len(h):
                    for column in (digests, fps, keys):
                        column.append(None)
                    continue
                sig = signature(h)
                digests.append(digest(h))
                fps.append(low_bits(sig))
                keys.append(band_keys(sig))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["n", "digest", "fp", "keys"])

    return describe(text)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, cell: int = CELL, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text): component_id is
    the smallest doc_id that can be reached over links, the own one included; kept says that it is
    the own one.

    Null texts and texts without words have no shingles and are linked with nothing, not even with
    each other. Very long texts are taken whole. A null doc_id takes part, but is a component_id only
    where no other is (then it is kept). Rows that repeat are linked as copies and all bear the same
    result. An empty table gives an empty result. Other columns are not read."""
    if percent < 80:
        raise ValueError("bands and bits are made for a similarity of at least 80 %")
    sig = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), described(F.col("text"), k).alias("d"))
    sig = written(sig.select("doc_id", "text_hash", "d.*"), "minhash")
    classes = written(classes_of(sig.where("n > 0")), "minhash-classes")
    roots = components(compare(classes.select("fp", F.explode("keys").alias("key")), RADIUS, cell))
    edges = confirmed(docs, classes, roots, partial(shingle_set, k=k), lambda h: band_keys(signature(h)), BANDS, percent, cell, cell_shingles)
    links = components(edges)
    linked = classes.select("digest", "best.doc_id").join(links, F.col("digest") == F.col("u"), "left").select("digest", "doc_id", F.coalesce("v", "digest").alias("root"))
    linked = written(linked, "minhash-linked")
    least = linked.groupBy(F.col("root").alias("l_root")).agg(F.min("doc_id").alias("component_id"))
    ids = written(linked.join(least, F.col("root") == F.col("l_root")).select(F.col("digest").alias("c_digest"), "component_id"), "minhash-ids")
    out = sig.join(ids, F.col("digest") == F.col("c_digest"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose doc_id is a near-duplicate of a smaller one. Rows of one doc_id
    are kept or go together. All columns are kept, whatever their names; nulls, long and empty texts
    as in near_duplicates()."""
    kept_id, = fresh(docs, "kept_id")
    kept = near_duplicates(docs, k, percent).where("kept").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)), "left_semi")
