"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: the hash of every word shingle votes on the bits. Two fingerprints are linked if they
differ in at most `radius` bits. They are compared within buckets, as bit planes: word b of a group
of 64 lanes holds bit b of its 64 fingerprints. A query fingerprint is compared with 64 lanes at
once: each plane is XORed with the query's bit, seven planes at a time go through carry-save adders
into vertical counters, lanes whose counter overflows are past the radius, and words whose lanes
are all past it are abandoned.

Two ways lead to buckets:
* near_duplicates(): 64 bits and a radius of at most 4. Two fingerprints that differ in at most 4
  bits agree on at least 2 of 6 blocks of their bits, so all links lie within the buckets of 15
  keys (one for each pair of blocks). In a large bucket the rest, cut into five, agrees on one part
  at least and is dealt by that. No link is missed.
* deduplicate(): 256 bits over five-word shingles and a radius of 64, within which texts of a
  Jaccard similarity of 0.8 are (their expected distance is 39 bits). Keys are bands of the least
  shingle hashes under random multipliers; two texts of similarity 0.8 share a bucket with a
  probability of 0.996. What is linked so are candidates, confirmed on the full sets of shingles.

Scale: texts are read once and never shuffled by the search. Exact copies collapse to one
fingerprint first. A bucket of more than `cell` fingerprints is dealt out as pairs of chunks, so no
bucket has to fit one task, and every pair of fingerprints still meets. A task returns a spanning
star per group, never all pairs. Components are joined by alternating large-star and small-star
steps whose tables are written to the shared folder, so nothing is gathered on the driver but two
numbers a round, and a lost executor costs one round at most."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import fresh, mix64, texts_of, written
from .confirm import classes_of, confirmed, digest

RADIUS = 4
#: Bits of each block, low bits first; two agreeing blocks remain among six when four bits differ.
WIDTHS = (11, 11, 11, 11, 10, 10)
#: Bits of the parts that the other four blocks are cut into, of which one agrees.
PARTS = (9, 9, 9, 9, 8)
#: Fingerprints, radius, shingles and keys of deduplicate().
BITS, WIDE_RADIUS, SHINGLE, BANDS, ROWS = 256, 64, 5, 14, 5
#: Similarity of near-duplicates of deduplicate(), in per cent of the union.
PERCENT = 80
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)
#: Comparisons of one query with one 64-lane word that are held in memory at a time.
ENTRIES = 1 << 17
#: Shingles whose votes are counted at a time.
VOTERS = 1 << 14
#: Edges to a partition of the tables that components() writes, where every core has one.
EDGES = 200_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, or of all words of a shorter text; none without a word."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, white space of the contract
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    end = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    shingles = (joined[s:e] for s, e in zip(start[: 1 - k].tolist(), end[k - 1 :].tolist(), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(w) - k + 1)


def votes(h: np.ndarray, bits: int = 64) -> np.ndarray:
    """The fingerprint of shingle hashes: `bits` / 64 numbers, a bit set where over half the hashes
    set it. Beyond the first 64 bits a shingle votes with further hashes of its hash."""
    ones = np.zeros(bits, np.int64)
    for a in range(0, len(h), VOTERS):
        part = h[a : a + VOTERS]
        lanes = np.stack([part, *(mix64(part + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) for i in range(1, bits // 64))], axis=1)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def simhash(text: str | None, k: int = 4) -> int:
    """Fingerprint of a text as a signed 64-bit number; 0 for a text without words."""
    return int(votes(shingle_hashes(text, k)).view(np.int64)[0])


_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | ONE


def band_keys(h: np.ndarray) -> np.ndarray:
    """One key (int64) for each band: a hash of the least products of the shingle hashes with its factors."""
    least = np.full(BANDS * ROWS, ALL)
    for a in range(0, len(h), VOTERS):
        least = np.minimum(least, (h[a : a + VOTERS, None] * _FACTORS).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(ROWS, BANDS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view(np.int64)


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp (signed 64 bits) of every row of docs (doc_id, text)."""

    @F.arrow_udf(LongType())
    def fp(text: pa.Array) -> pa.Array:
        return pa.array([simhash(t, k) for part in texts_of(text) for t in part], pa.int64())

    return docs.select("doc_id", fp(F.col("text")).alias("fp"))


def shingle_set(text: str | None) -> np.ndarray:
    """Distinct five-word shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, SHINGLE))


def wide_fingerprint(text: Column) -> Column:
    """n and digest of a text's set of five-word shingles, its fp (binary, 256 bits; repeats count)
    and keys (one long for each band)."""

    @F.arrow_udf("struct<n:bigint,digest:binary,fp:binary,keys:array<bigint>>")
    def wide(text: pa.Array) -> pa.Array:
        n, digests, fps, keys = [], [], [], []
        for part in texts_of(text):
            for t in part:
                h = shingle_hashes(t, SHINGLE)
                distinct = np.unique(h)
                n.append(len(distinct))
                digests.append(digest(distinct))
                fps.append(votes(h, BITS).tobytes())
                keys.append(band_keys(distinct))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), listed], names=["n", "digest", "fp", "keys"])

    return wide(text)


def planes_of(x: np.ndarray) -> np.ndarray:
    """Bit planes [bits, words] of fingerprints [n, bits / 64], 64 lanes to a word, the last word
    padded with 0."""
    x = x.reshape(len(x), -1)
    lanes = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.uint64)
    lanes[: len(x)] = x
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 64, 8 * x.shape[1]), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def _sum3(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: the sum bit and the carry of three bits, in every lane."""
    u = x ^ y
    return u ^ z, (x & y) | (u & z)


def within(planes: np.ndarray, word: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each entry (a word of planes, a query fingerprint, the lanes that count): the lanes
    at most `radius` bits from the query, as a bit mask."""
    query = query.reshape(len(query), -1)
    result = np.zeros(len(word), np.uint64)
    at = np.arange(len(word))
    over = ~lanes
    levels = max(1, int(radius).bit_length())
    bias = (1 << levels) - 1 - radius  # so that a counter overflows at radius + 1
    count = [np.full_like(over, ALL if bias >> v & 1 else 0) for v in range(levels)]
    for first in range(0, len(planes), 7):
        d = [planes[b][word] ^ (np.uint64(0) - ((query[:, b // 64] >> np.uint64(b % 64)) & ONE)) for b in range(first, min(first + 7, len(planes)))]
        d += [np.zeros_like(over)] * (7 - len(d))
        s, a = _sum3(d[0], d[1], d[2])
        s, b = _sum3(s, d[3], d[4])
        s, c = _sum3(s, d[5], d[6])
        two, four = _sum3(a, b, c)
        rest = [s, two, four]
        carry = None
        for v in range(max(levels, 3)):
            more = [x for x in (rest[v] if v < 3 else None, carry) if x is not None]
            carry = None
            if v >= levels:
                for x in more:
                    over |= x
            elif len(more) == 2:
                count[v], carry = _sum3(count[v], *more)
            else:
                count[v], carry = count[v] ^ more[0], count[v] & more[0]
        if carry is not None:
            over |= carry
        live = over != ALL
        kept = int(np.count_nonzero(live))
        if not kept:
            return result
        if kept < 0.75 * len(live):
            at, word, query, over = at[live], word[live], query[live], over[live]
            count = [x[live] for x in count]
    result[at] = ~over
    return result


def lowest(mask: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit."""
    return np.bitwise_count((mask & (~mask + ONE)) - ONE).astype(np.int64)


def _lanes(mask: np.ndarray) -> np.ndarray:
    """Positions of the bits set in words of 64 lanes."""
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _groups(x: np.ndarray, radius: int):
    """(root, members) of each group of linked fingerprints of a large run, one group after the
    other. What a group has reached needs no further comparison with it, so each fingerprint is
    compared only with words that hold lanes not yet reached: a dense group costs little more than
    its first comparison. Roots are compared in batches, which grow where groups are small."""
    planes = planes_of(x)
    left = np.full(planes.shape[1], ALL)
    left[-1] = ALL >> np.uint64(len(left) * 64 - len(x))

    def links(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return within(planes, np.tile(at, len(q)), np.repeat(x[q], len(at), axis=0), np.tile(left[at], len(q)), radius).reshape(len(q), -1)

    batch = 4
    while left.any():
        at = np.flatnonzero(left)
        roots = _lanes(left)[: max(1, min(batch, ENTRIES // len(at)))]
        near = links(roots, at)
        groups = 0
        for i, root in enumerate(roots.tolist()):
            if not left[root // 64] >> np.uint64(root % 64) & ONE:
                continue
            groups += 1
            left[root // 64] &= ~(ONE << np.uint64(root % 64))
            fresh_lanes = np.zeros_like(left)
            fresh_lanes[at] = near[i] & left[at]
            reached = []
            front = _lanes(fresh_lanes)
            left &= ~fresh_lanes
            while len(front):
                reached.append(front)
                fresh_lanes = np.zeros_like(left)
                done = 0
                while done < len(front) and left.any():
                    rest = np.flatnonzero(left)
                    part = front[done : done + max(1, min(64 + done, ENTRIES // len(rest)))]
                    done += len(part)
                    more = np.bitwise_or.reduce(links(part, rest), axis=0)
                    left[rest] &= ~more
                    fresh_lanes[rest] |= more
                front = _lanes(fresh_lanes)
            if reached:
                yield root, np.concatenate(reached)
        batch = batch * 2 if 2 * groups > len(roots) else 4


def stars(runs: list[np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) that join each group of linked fingerprints within its run. Runs
    [n, bits / 64] hold distinct fingerprints; small ones share words of 64 lanes."""
    runs = [r.reshape(len(r), -1) for r in runs]
    width = runs[0].shape[1] if runs else 1
    members, roots = [np.zeros((0, width), np.uint64)], [np.zeros((0, width), np.uint64)]
    small = [r for r in runs if 2 <= len(r) <= 64]
    if small:
        size = np.fromiter(map(len, small), np.int64, len(small))
        first = np.zeros(len(small), np.int64)
        at = 0
        for i, n in enumerate(size.tolist()):  # a run never crosses a word
            if at % 64 + n > 64:
                at += 64 - at % 64
            first[i] = at
            at += n
        lane = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        x = np.zeros((-(-at // 64) * 64, width), np.uint64)
        x[lane] = np.concatenate(small)
        own = ((ALL >> (np.uint64(64) - size.astype(np.uint64))) << (first % 64).astype(np.uint64)).repeat(size)
        planes = planes_of(x)
        reach = np.zeros((len(x) // 64, 64), np.uint64)
        for a in range(0, len(lane), ENTRIES):
            part = lane[a : a + ENTRIES]
            reach.reshape(-1)[part] = within(planes, part // 64, x[part], own[a : a + ENTRIES], radius)
        for k in range(64):  # transitive closure of the links inside each word
            via = (reach >> np.uint64(k)) & ONE
            reach |= (np.uint64(0) - via) & reach[:, k : k + 1]
        closed = reach.reshape(-1)[lane]
        root = (lane // 64) * 64 + lowest(closed)
        moved = (closed != 0) & (root != lane)
        members.append(x[lane[moved]])
        roots.append(x[root[moved]])
    for x in runs:
        if len(x) > 64:
            for root, found in _groups(x, radius):
                members.append(x[found])
                roots.append(np.repeat(x[root : root + 1], len(found), axis=0))
    return np.concatenate(members), np.concatenate(roots)


def _numbers(fp: pa.Array) -> np.ndarray:
    """Fingerprints [n, bits / 64] of an Arrow column of longs or of binaries of one length."""
    if pa.types.is_binary(fp.type):
        return np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(fp), -1)
    return fp.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, 1)


def _column(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_binary(kind):
        return pa.array([row.tobytes() for row in x], kind)
    return pa.array(x.reshape(-1).view(np.int64), kind)


def _edges(batches, radius: int):
    """Arrow batches of (key, a, b, fp) sorted by key, a and b into edges (u, v) with u the member
    and v the root. Only the run that a batch ends in is carried over."""
    held: list[np.ndarray] = []
    held_key = None
    done: list[np.ndarray] = []
    waiting, kind = 0, pa.int64()

    def flush():
        nonlocal done, waiting
        u, v = stars(done, radius)
        done, waiting = [], 0
        return pa.RecordBatch.from_arrays([_column(u, kind), _column(v, kind)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:3])
        kind = batch.column(3).type
        fp = _numbers(batch.column(3))
        cut = np.flatnonzero((key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
        bounds = np.concatenate(([0], cut, [len(fp)]))
        head = (key[0], a[0], b[0])
        if held_key is not None and held_key != head:
            done.append(np.concatenate(held))
            held = []
        for i in range(len(bounds) - 1):
            run = fp[bounds[i] : bounds[i + 1]]
            if i == 0 and held:
                held.append(run)
                if len(bounds) > 2:
                    done.append(np.concatenate(held))
                    waiting += len(done[-1])
                    held = []
            elif i == len(bounds) - 2:
                held = [run]
            elif len(run) > 1:
                done.append(run)
                waiting += len(run)
        held_key = (key[-1], a[-1], b[-1])
        if waiting > 50_000:
            yield flush()
    if held:
        done.append(np.concatenate(held))
    if done:
        yield flush()


def _blocks(fp: Column) -> list[Column]:
    starts = [sum(WIDTHS[:i]) for i in range(len(WIDTHS))]
    return [F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, WIDTHS, strict=True)]


_PAIRS = list(combinations(range(len(WIDTHS)), 2))


def _bucket_keys(fp: Column) -> Column:
    """The 15 keys of a fingerprint: number of the pair of blocks, then the bits of both."""
    block = _blocks(fp)
    return F.array(*[F.lit(n << 22) + F.shiftleft(block[i], WIDTHS[j]) + block[j] for n, (i, j) in enumerate(_PAIRS)])


def _part_keys(fp: Column, key: Column) -> Column:
    """The five keys of a fingerprint within bucket `key`: the bucket, then number and bits of a
    part of what the two blocks of the bucket leave."""
    block = _blocks(fp)

    def left(i: int, j: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(len(WIDTHS)):
            if k not in (i, j):
                out = F.shiftleft(out, WIDTHS[k]) + block[k]
        return out

    free = F.element_at(F.array(*[left(i, j) for i, j in _PAIRS]), (F.shiftright(key, 22) + 1).cast("int"))
    starts = [sum(PARTS[:i]) for i in range(len(PARTS))]
    return F.array(*[F.shiftleft(key, 12) + F.lit(i << 9) + F.shiftrightunsigned(free, s).bitwiseAND(F.lit((1 << w) - 1)) for i, (s, w) in enumerate(zip(starts, PARTS, strict=True))])


def _large(rows: DataFrame, cell: int) -> DataFrame:
    """l_key, chunks of the buckets of more than `cell` rows."""
    n = rows.groupBy("key").count().where(F.col("count") > cell)
    return written(n.select(F.col("key").alias("l_key"), F.ceil(F.col("count") / cell).cast("int").alias("chunks")), "simhash-large")


def compare(rows: DataFrame, radius: int, cell: int = 4096, large: DataFrame | None = None) -> DataFrame:
    """u, v: edges that join all groups of linked fingerprints of rows (key, fp), both of them in
    one bucket. Buckets of more than `cell` rows (`large`, where they are known) are dealt as pairs
    of chunks."""
    kind = rows.schema["fp"].dataType.simpleString()
    large = _large(rows, cell) if large is None else large
    if large.limit(1).count():
        n = F.coalesce("chunks", F.lit(1))
        dealt = rows.join(large, F.col("key") == F.col("l_key"), "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), n).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        dealt = dealt.select("key", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "fp")
    else:
        dealt = rows.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    spread = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    return spread.mapInArrow(lambda batches: _edges(batches, radius), f"u {kind}, v {kind}").distinct()


def link(distinct: DataFrame, radius: int = RADIUS, cell: int = 4096) -> DataFrame:
    """u, v: edges that join all groups of linked fingerprints of distinct (fp), 64 bits each."""
    if not 0 <= radius <= RADIUS:
        raise ValueError("the buckets are made for a radius of at most 4")
    rows = distinct.select("fp", F.explode(_bucket_keys(F.col("fp"))).alias("key"))
    large = _large(rows, cell)
    if not large.limit(1).count():
        return compare(rows, radius, cell, large)
    near = rows.join(large, F.col("key") == F.col("l_key"), "left")
    # a key of its own for what is cut no further: the five parts are numbered 0 to 4
    keys = F.when(F.col("chunks").isNull(), F.array(F.shiftleft("key", 12) + F.lit(5 << 9))).otherwise(_part_keys(F.col("fp"), F.col("key")))
    return compare(near.select("fp", F.explode(keys).alias("key")), radius, cell)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """u, v: each node with the smallest node it is connected to, for nodes that have an edge and
    aren't that node. Nodes are of any type that has an order. Alternates large-star and small-star
    until nothing moves. The tables of a round are written in as many files as their edges need, not
    in one for each shuffle partition, but in no fewer than there are cores."""
    cores = edges.sparkSession.sparkContext.defaultParallelism

    def save(e: DataFrame, what: str) -> DataFrame:
        return written(e.coalesce(max(cores, -(-2 * before[0] // EDGES))), what)

    def mins(e: DataFrame) -> DataFrame:
        return save(e.groupBy(F.col("u").alias("m_u")).agg(F.least(F.min("v"), F.min("u")).alias("m")), "cc-min")

    def join(e: DataFrame) -> DataFrame:
        return e.join(mins(e), F.col("u") == F.col("m_u"))

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    before = state(e)
    if not before[0]:
        return e
    for _ in range(max_rounds):
        both = save(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-both")
        large = save(join(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "cc-large")
        near = join(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        e = save(small.where("u != v").distinct(), "cc-edges")
        after = state(e)
        if after == before:
            return e
        before = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = RADIUS, cell: int = 4096) -> DataFrame:
    """doc_id, fp, component_id for every row of docs (doc_id, text): component_id is the smallest
    doc_id that can be reached by links, the own one included.

    Null and empty texts have fingerprint 0 and are linked like any other. A null doc_id takes
    part, but is a component_id only where no other is; rows that repeat are linked as copies.
    Components whose smallest ids are equal, as rows of one doc_id make them, bear the same
    component_id. An empty table gives an empty result. Other columns are not read."""
    fps = written(fingerprints(docs, k), "simhash")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    roots = components(link(reps.select("fp"), radius, cell))
    named = reps.join(roots, F.col("fp") == F.col("u"), "left").select("fp", "least_id", F.coalesce("v", "fp").alias("root"))
    named = written(named, "simhash-roots")
    least = written(named.groupBy(F.col("root").alias("l_root")).agg(F.min("least_id").alias("component_id")), "simhash-least")
    classes = written(named.join(least, F.col("root") == F.col("l_root")).select(F.col("fp").alias("c_fp"), "component_id"), "simhash-classes")
    return fps.join(classes, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = WIDE_RADIUS, cell: int = 4096, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id (null last),
    ties by a hash of the text. Groups are joined by links of at least `percent` % of the union of
    both sets of five-word shingles.

    Groups are held apart by their shingles, not by doc_id: rows of equal or null doc_id and unlike
    texts all stay. Of rows that repeat doc_id and text one stays. Null and empty texts are one group;
    very long texts are taken whole. An empty table gives an empty result. Other columns are kept,
    whatever their names and types."""
    if percent < 80:
        raise ValueError("the radius and the bands are made for a similarity of at least 80 %")
    sig = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), wide_fingerprint(F.col("text")).alias("w"))
    sig = written(sig.select("doc_id", "text_hash", "w.*"), "simhash-wide")
    classes = written(classes_of(sig), "simhash-classes")
    roots = components(compare(classes.select("fp", F.explode("keys").alias("key")), radius, cell))
    links = components(confirmed(docs, classes, roots, shingle_set, band_keys, BANDS, percent, cell))
    named = classes.join(links, F.col("digest") == F.col("u"), "left").groupBy(F.coalesce("v", "digest").alias("root")).agg(F.min("best").alias("best"))
    kept_id, kept_hash, hashed, copy_id, copy_hash = fresh(docs, "kept_id", "kept_hash", "text_hash", "copy_id", "copy_hash")
    kept = written(named.select(F.col("best.doc_id").alias(kept_id), F.col("best.text_hash").alias(kept_hash)), "simhash-kept")
    copies = sig.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col("text_hash") == F.col(kept_hash)), "left_semi")
    copies = written(copies.groupBy(F.col("doc_id").alias(copy_id), F.col("text_hash").alias(copy_hash)).count().where("count > 1").drop("count"), "simhash-copies")
    rows = docs.withColumn(hashed, F.xxhash64("text"))
    # kept grows with the corpus, so it is never broadcast; each task builds a table of its own share
    out = rows.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(hashed) == F.col(kept_hash)), "left_semi")
    if copies.limit(1).count():
        same = F.col("doc_id").eqNullSafe(F.col(copy_id)) & (F.col(hashed) == F.col(copy_hash))
        once = out.join(copies, same, "left_semi").dropDuplicates(["doc_id", hashed])
        out = out.join(copies, same, "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
