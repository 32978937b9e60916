"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Tables written by this process under the shared folder, removed by clean().
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in
    tests, gets a temporary folder where none is set; a cluster without one is an error, as its
    executors would each write to a disk of their own."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder, which clean() removes."""
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back (columnar, with sizes that
    adaptive execution can use). A lost executor then costs no recomputation."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove every table, archive and index that this process wrote to the shared folder, files of
    failed attempts included, and say how many. Results of operators that have not been read or
    saved yet need them, so the caller says when."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each of names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array | pa.ChunkedArray, chars: int = 4_000_000, rows: int = 500) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in order, as lists of at most `rows` texts that end once they
    hold `chars` characters. Spark bounds the bytes of a batch; this bounds what is worked on at once."""
    part: list[str | None] = []
    size = 0
    for x in column:
        part.append(x.as_py())
        size += len(part[-1] or "")
        if size >= chars or len(part) == rows:
            yield part
            part, size = [], 0
    if part:
        yield part


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 4 is 2: rows that no classifier learns from.
    A null doc_id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))


def is_held_out(doc_id) -> bool:
    """Python form of held_out(), for tests."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def thinned(df: DataFrame, label: str, key: list[str], total: int, least: int = 0, seed: int = 7) -> tuple[DataFrame, int]:
    """About `total` rows of df, an equal share for each label but no less than `least` rows (so more
    in all if there are many labels), chosen by a hash of label and key; and how many that makes at
    most. Null labels are left out. Labels are counted by a partial aggregation, one row of each comes
    to the driver (a model holds far more of each), and no class is gathered in one task. Rows of equal
    label and key come and go together, so a caller that collects bounds the result by at_most()."""
    known = df.where(F.col(label).isNotNull())
    counts = known.groupBy(label).count().collect()
    if not counts:
        return known.limit(0), 0
    each = max(total / len(counts), least)
    share = F.map_from_arrays(F.array(*[F.lit(r[0]) for r in counts]), F.array(*[F.lit(min(1.0, each / r[1])) for r in counts]))
    return known.where(_coin([label, *key], seed) < F.element_at(share, F.col(label))), max(total, len(counts) * least)


def at_most(df: DataFrame, key: list[str], total: int, seed: int = 7) -> DataFrame:
    """df with one row of each key and no more than `total` rows, those of the least hashes."""
    return df.dropDuplicates(key).orderBy(_coin(key, seed), *key).limit(total)


def _coin(key: list[str], seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_003)) / 1_000_003.0


def code_points(text: str) -> np.ndarray:
    """Code points of a text as uint32."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
