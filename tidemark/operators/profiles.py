"""A sparse linear model over profile features: weights as a table, scores with their reasons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import profiles as P
from tidemark.functions import text as T
from tidemark.plans.store import cut

#: Weights are whole multiples of this, so that sums don't depend on their order.
UNIT = 1e-4
#: Features that a task works on at once.
AT_ONCE = 1 << 18


def features(docs: DataFrame, key: str, text: str, others: Sequence[str] = ()) -> DataFrame:
    """key, others, features of every row of docs; nulls are empty texts, which have none."""
    return docs.select(key, *others, P.profile_features(text).alias("features"))


def log_odds(rows: DataFrame, label: str, least: int = 5) -> DataFrame:
    """feature, weight (in UNITs) of rows (features, label 0 or 1): the log of the odds of a feature
    among rows of label 1 to those of label 0, both counted one more. Features of fewer than `least`
    rows have no weight; null labels don't count. Two partial aggregations, no row at the driver."""
    known = rows.where(F.col(label).isNotNull())
    # an inner explode would filter by the features, and so work them out twice
    counts = known.select(F.explode_outer("features").alias("feature"), label).groupBy("feature").agg(F.sum(label).alias("pos"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("feature").isNotNull())
    total = known.agg(F.coalesce(F.sum(label), F.lit(0)).alias("all_pos"), F.count("*").alias("all_n"))
    ratio = (F.col("pos") + 1) * (F.col("all_n") - F.col("all_pos") + 2) / ((F.col("n") - F.col("pos") + 1) * (F.col("all_pos") + 2))
    return counts.crossJoin(F.broadcast(total)).select("feature", F.round(F.log(ratio) / UNIT).cast("long").alias("weight"))


def predict(rows: DataFrame, key: str, weights: DataFrame, intercept: float = 0.0, top: int = 8, few: int = 15_000_000, block: int = 1 << 18, text: str | None = None) -> DataFrame:
    """key, n_features, n_known, logit, p and reasons (feature, contribution; the `top` of largest
    size, ties by feature) of every row of rows (key unique, features, or the text that has them). A
    feature's value is one over the square root of their number, so that length doesn't decide;
    contributions sum to the logit less the intercept. Rows without a known feature have the intercept alone.

    Up to `few` weights (unique features) go to every task, in compressed blocks of about `block` weights
    that are read one at a time, and no feature is shuffled; a larger table is joined, with the same
    result."""
    weights = cut(weights.select("feature", "weight"))
    n = weights.count()
    if n <= few:
        out = _known_of_few(rows, key, weights, top, -(-n // block) or 1, text)
    else:
        out = _known_by_join(features(rows, key, text) if text else rows, key, weights, top)
    value = UNIT / F.sqrt(F.greatest("n", F.lit(1)))
    logit = F.lit(float(intercept)) + F.coalesce(F.col("total"), F.lit(0)) * value
    reasons = F.transform(F.coalesce("best", F.array().cast(BEST)), lambda b: F.struct(b["feature"].alias("feature"), (b["weight"] * value).alias("contribution")))
    bounded = F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))
    return out.select(key, F.col("n").cast("long").alias("n_features"), F.coalesce("n_known", F.lit(0)).cast("long").alias("n_known"), logit.alias("logit"), (1 / (1 + F.exp(-bounded))).alias("p"), reasons.alias("reasons"))


BEST = "array<struct<feature:string,weight:bigint>>"


def _known_by_join(rows: DataFrame, key: str, weights: DataFrame, top: int) -> DataFrame:
    """key, n, n_known, total, best of rows, whose features are joined with weights."""
    each = rows.select(key, F.explode("features").alias("feature")).join(weights, "feature")
    largest = F.slice(F.array_sort(F.collect_list(F.struct((-F.abs("weight")).alias("size"), "feature", "weight"))), 1, top)
    best = F.transform(largest, lambda b: F.struct(b["feature"].alias("feature"), b["weight"].alias("weight")))
    found = each.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n_known"), F.sum("weight").alias("total"), best.alias("best"))
    # the features themselves are not shuffled once more
    return rows.select(key, F.size("features").alias("n")).join(found, F.col(key) == F.col("__k"), "left").select(key, "n", "n_known", "total", "best")


def _block(terms: pa.Array, blocks: int) -> np.ndarray:
    """The block of each term, by a hash of its bytes (of the first 64, and their number)."""
    out = []
    for i in range(0, len(terms), AT_ONCE):
        some = terms[i : i + AT_ONCE]
        ends = np.frombuffer(some.buffers()[1], np.int32, len(some) + 1, 4 * some.offset).astype(np.int64)
        data = np.append(np.frombuffer(some.buffers()[2] or b"", np.uint8), np.uint8(0))
        sizes = np.diff(ends)
        h = sizes.astype(np.uint32)
        for k in range(min(64, sizes.max())):
            h = np.where(k < sizes, h * np.uint32(31) + data[np.minimum(ends[:-1] + k, len(data) - 1)], h)
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(8))
    return (np.concatenate(out) if out else np.zeros(0, np.uint32)).astype(np.int64) % blocks


def _in_blocks(weights: DataFrame, blocks: int) -> dict[int, bytes]:
    """The weights of each block: an Arrow stream, sorted so that it compresses."""

    @F.arrow_udf("int")
    def block_of(feature: pa.Array) -> pa.Array:
        return pa.array(_block(feature.cast(pa.string()), blocks), pa.int32())

    def pack(t: pa.Table) -> pa.Table:
        block, t = t.column("block")[:1], t.select(["feature", "weight"]).sort_by("feature").combine_chunks()
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        return pa.table({"block": block, "packed": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    dealt = weights.select(block_of("feature").alias("block"), "feature", "weight")
    out = dealt.groupBy("block").applyInArrow(pack, "block int, packed binary").toArrow()
    return dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """The batches joined, and cut by rows, to about `size` bytes: each is met with all weights, and held
    with what is worked out of it."""
    held: list[pa.RecordBatch] = []

    def joined() -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
            step = max(1, b.num_rows * size // max(b.nbytes, 1))
            yield from (b.slice(i, step) for i in range(0, b.num_rows, step))

    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from joined()
            held.clear()
    yield from joined()


def _numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many features each list has, which they are, and the different features themselves."""
    each = lists.flatten().dictionary_encode()
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False), each.indices.fill_null(len(each.dictionary)).to_numpy(), each.dictionary.cast(pa.string())


def _known_of_few(rows: DataFrame, key: str, weights: DataFrame, top: int, blocks: int, text: str | None) -> DataFrame:
    """The same where every task has all weights, in blocks."""
    shared = rows.sparkSession.sparkContext.broadcast(_in_blocks(weights, blocks))
    kind = pa.list_(pa.struct([("feature", pa.string()), ("weight", pa.int64())]))

    def known(terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The places of the terms that have a weight, by size of weight and then by term, and the weights."""
        dealt = _block(terms, blocks)
        order = np.argsort(dealt, kind="stable")
        ends = np.searchsorted(dealt[order], np.arange(blocks + 1))
        places, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, packed in shared.value.items():
            own = order[ends[k] : ends[k + 1]]
            t = pa.ipc.open_stream(packed).read_all().combine_chunks()
            at = pc.index_in(t.column(0).cast(pa.string()), value_set=terms.take(pa.array(own)))
            places.append(own[at.drop_null().to_numpy()])
            values.append(t.column(1).filter(at.is_valid()).to_numpy())
        place, value = np.concatenate(places), np.concatenate(values)
        found = pa.table({"size": -np.abs(value), "term": terms.take(pa.array(place))})
        by = pc.sort_indices(found, sort_keys=[("size", "ascending"), ("term", "ascending")]).to_numpy()
        return place[by], value[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            n, each, terms = P.numbered_features(b.column(1).cast(pa.string())) if text else _numbered(b.column(1))
            place, value = known(terms)
            rank = np.full(len(terms) + 1, -1, np.int32)
            rank[place] = np.arange(len(place))
            # a part of the rows at once, so that what is worked out for each of their features stays small
            starts = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
            cuts = np.unique(np.concatenate((np.searchsorted(starts, np.arange(0, starts[-1], AT_ONCE)), [0, len(n)])))
            for i, j in zip(cuts, cuts[1:]):
                yield scored(b.column(0)[i:j], n[i:j], rank[each[starts[i] : starts[j]]], terms, place, value)
            del b, each, terms, place, value, rank
            pa.default_memory_pool().release_unused()

    def scored(keys: pa.Array, n: np.ndarray, at: np.ndarray, terms: pa.Array, place: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        row, at = np.repeat(np.arange(len(n)), n)[at >= 0], at[at >= 0]
        count = np.bincount(row, minlength=len(n))
        ends = np.cumsum(count)
        sums = np.concatenate(([0], np.cumsum(value[at])))
        at = np.sort(row * (len(place) + 1) + at) % (len(place) + 1)
        best = at[np.arange(len(at)) - np.repeat(ends - count, count) < top]
        found = pa.StructArray.from_arrays([terms.take(pa.array(place[best])), pa.array(value[best])], fields=list(kind.value_type))
        offsets = np.concatenate(([0], np.cumsum(np.minimum(count, top)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), found)
        return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int32()), pa.array(count, pa.int64()), pa.array(sums[ends] - sums[ends - count], pa.int64()), lists], ["k", "n", "n_known", "total", "best"])

    read = F.lower(T.empty_if_null(text)) if text else F.col("features")
    out = rows.select(F.col(key).alias("k"), read.alias("of")).mapInArrow(run, f"k {dict(rows.dtypes)[key]}, n int, n_known long, total long, best {BEST}")
    return out.withColumnRenamed("k", key)
