"""WARC archives with a two-level capture index.

write_archive() writes one record for each page into .warc.gz files (one gzip member a record) in
the shared folder. build_index() sorts reversed-host URL keys into compressed blocks of lines,
range-partitioned into shards; every shard has a directory with the first key of each block, and
the shards' own first keys form the top level. lookup() binary-searches shards, then blocks, and
range-reads one block; read_records() range-reads the records.

Payloads of at least `least` bytes that are equal share one response record, that of the smallest
page_id; the others are revisit records without a payload.

Scale: html is shuffled at most once, to meet the copies of its digest (an exchange that adaptive
execution splits when one digest is hot). Index lines and queries are sorted by (key, page_id), so
that a host or URL with most of the captures is spread over shards. A task that is run again
writes files of a new name, and only files named in the committed manifest are read. Files are
reached with pyarrow.fs by URI, on any store that it knows; the driver reads one row a shard."""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written

CRLF = b"\r\n"
#: Bytes after which a task starts its next archive file; lines of an index block.
ROLL, BLOCK = 256_000_000, 3000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def surt(url: Column) -> Column:
    """Reversed-host key of a URL: com,example,blog)/path?query. Scheme, user, www, default port
    and fragment are dropped; null and URLs without a host give '-'."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?"
    host = F.regexp_replace(F.lower(F.regexp_extract(url, scheme + r"([^/?#:]*)", 1)), r"^www\d*\.", "")
    port = F.regexp_extract(url, scheme + r"[^/?#:]*(:\d+)", 1)
    port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    rest = F.regexp_extract(url, scheme + r"[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), rest)
    return _plain(F.when(host != "", key).otherwise(F.lit("-")))


def _plain(c: Column) -> Column:
    """Index fields hold no tab or line break once these are percent-encoded."""
    return F.replace(F.replace(F.replace(c, F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A")), F.lit("\r"), F.lit("%0D"))


def _page(c: Column) -> Column:
    return _plain(F.coalesce(c.cast("string"), F.lit("")))


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _record(page_id: str, url: str, payload: bytes | None, n_bytes: int, digest: str, refers_to: str | None, date: str) -> bytes:
    kind = "revisit" if payload is None else "response"
    block = b"" if payload is None else HTTP % len(payload) + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return CRLF.join([*(h.replace("\r", "%0D").replace("\n", "%0A").encode() for h in head), b"", block, b"", b""])


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record (uncompressed)."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    head = {"version": lines[0]} | dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    if data[end + 4 + len(block) :] != CRLF * 2:
        raise ValueError("a record doesn't end where its length says")
    return head | {"payload": block[block.index(b"\r\n\r\n") + 4 :] if block else None}


def _write(batches, root: str, date: str, roll: int):
    """Append records to files of this attempt's own name; one row of place for each."""
    out, path, at = None, "", 0
    for batch in batches:
        places = []
        for row in range(batch.num_rows):  # one page in memory at a time
            page_id, url, html, n_bytes, digest, refers_to = (c[row].as_py() for c in batch.columns[:6])
            if out is None:
                path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                fs, inner = _fs(path)
                out = fs.open_output_stream(inner, compression=None)
            payload = None if refers_to is not None else (html or "").encode()
            packer = zlib.compressobj(3, zlib.DEFLATED, 31)
            data = packer.compress(_record(page_id, url or "", payload, n_bytes, digest, refers_to, date)) + packer.flush()
            out.write(data)
            places.append((path, at, len(data)))
            at += len(data)
            if at >= roll:
                out.close()
                out = None
        if places:
            file, start, n = zip(*places, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(6), batch.column(0), pa.array(file), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["key", "page", "file", "offset", "length"])
    if out is not None:
        out.close()


def write_archive(pages: DataFrame, least: int = 100, date: str = "1970-01-01T00:00:00Z", roll: int = ROLL) -> DataFrame:
    """Write a record for every row of pages (page_id, url, html); returns the manifest: key,
    page (page_id as text), file, offset, length.

    A null html is an empty payload. Rows that repeat the smallest page_id of equal payloads are
    all responses. A null page_id refers to the smallest id, or is a response where there is
    none. Very long payloads are written whole; an empty table gives an empty manifest. Other columns
    are not read."""
    root = new_folder(pages.sparkSession, "warc")
    fs, inner = _fs(root)
    fs.create_dir(inner, recursive=True)
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256)).withColumn("n_bytes", F.octet_length("html").cast("long"))
    groups = base.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select(F.col("digest").alias("g_digest"), "first_id"), "warc-copies")
    rows = base.join(groups, F.col("digest") == F.col("g_digest"), "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id").cast("string"))
    rows = rows.withColumn("refers_to", refers)
    html = F.when(F.col("refers_to").isNull(), F.col("html"))
    rows = rows.select(_page(F.col("page_id")).alias("page"), "url", html.alias("html"), "n_bytes", "digest", "refers_to", surt(F.col("url")).alias("key"))
    placed = rows.mapInArrow(lambda b: _write(b, root, date, roll), "key string, page string, file string, offset long, length long")
    return written(placed, "warc-manifest")


def _write_shard(batches, root: str, lines: int):
    """Compressed blocks of sorted lines and, in a second file, the block directory."""
    name = f"{root}/{uuid.uuid4().hex}"
    fs, inner = _fs(name)
    out, at, block, directory, last = None, 0, [], [], ""

    def pack():
        nonlocal at, block
        data = zlib.compress("\n".join(block).encode(), 6)
        out.write(data)
        directory.append(f"{block[0].rsplit(chr(9), 3)[0]}\t{at}\t{len(data)}")
        at += len(data)
        block = []

    for batch in batches:
        for key, page, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None:
                out = fs.open_output_stream(inner + ".cdx", compression=None)
            last = f"{key}\t{page}"
            block.append(f"{last}\t{file}\t{offset}\t{length}")
            if len(block) == lines:
                pack()
    if out is not None:
        if block:
            pack()
        out.close()
        with fs.open_output_stream(inner + ".dir", compression=None) as f:
            f.write(zlib.compress("\n".join(directory).encode(), 6))
        first = directory[0].rsplit("\t", 2)[0]
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([last]), pa.array([name])], names=["first", "last", "shard"])


def build_index(manifest: DataFrame, lines: int = BLOCK) -> DataFrame:
    """Write the index of a manifest; returns first, last, shard: one row for each shard."""
    root = new_folder(manifest.sparkSession, "cdx")
    fs, inner = _fs(root)
    fs.create_dir(inner, recursive=True)
    ordered = _ranged(manifest.select("key", "page", "file", "offset", "length"))
    return written(ordered.mapInArrow(lambda b: _write_shard(b, root, lines), "first string, last string, shard string"), "cdx-shards")


def _ranged(df: DataFrame) -> DataFrame:
    """Sorted by key and page in ranges; each range is a whole number of sorted tasks."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")


def _split(line: str) -> tuple[str, str]:
    key, page = line.split("\t", 2)[:2]
    return key, page


def _search(batches, shards: list[tuple[str, str, str]]):
    """Lines of the index that match (key, page), for queries in order."""
    firsts = [_split(s[0]) for s in shards]
    lasts = [_split(s[1]) for s in shards]
    opened: dict[int, tuple] = {}
    held: tuple[tuple[int, int] | None, list] = (None, [])
    for batch in batches:
        found = []
        for key, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            want = (key, page)
            s = bisect.bisect_left(lasts, want)
            while s < len(shards) and firsts[s] <= want:
                if s not in opened:
                    fs, inner = _fs(shards[s][2])
                    with fs.open_input_stream(inner + ".dir", compression=None) as f:
                        rows = [x.rsplit("\t", 2) for x in zlib.decompress(f.read()).decode().split("\n")]
                    for _, _, old in opened.values():
                        old.close()
                    opened = {s: ([_split(r[0]) for r in rows], [(int(r[1]), int(r[2])) for r in rows], fs.open_input_file(inner + ".cdx"))}
                starts, places, file = opened[s]
                b = max(0, bisect.bisect_left(starts, want) - 1)
                while b < len(starts) and starts[b] <= want:
                    if held[0] != (s, b):
                        file.seek(places[b][0])
                        held = ((s, b), zlib.decompress(file.read(places[b][1])).decode().split("\n"))
                    lines = held[1]
                    i = bisect.bisect_left(lines, want, key=_split)
                    while i < len(lines) and _split(lines[i]) == want:
                        found.append(lines[i].split("\t")[2:])
                        i += 1
                    b += 1
                s += 1
        if found:
            file_, offset, length = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(file_), pa.array(map(int, offset), pa.int64()), pa.array(map(int, length), pa.int64())], names=["file", "offset", "length"])
    for _, _, old in opened.values():
        old.close()


def lookup(queries: DataFrame, index: DataFrame) -> DataFrame:
    """file, offset, length of every capture that matches a row of queries (url, page_id).
    Repeated queries count once; a null url or page_id is matched like any other value, and an empty
    table of queries or index gives no row. index: build_index()'s shards, one small row for each task of
    the sort, which is what bounds the list that tasks get."""
    top = sorted((tuple(r) for r in index.collect()), key=lambda r: _split(r[0]))
    q = queries.select(surt(F.col("url")).alias("key"), _page(F.col("page_id")).alias("page")).distinct()
    return _ranged(q).mapInArrow(lambda b: _search(b, top), "file string, offset long, length long")


def _read(batches):
    path, file = None, None
    for batch in batches:
        rows = []
        for name, offset, length in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if name != path:
                if file is not None:
                    file.close()
                fs, inner = _fs(name)
                path, file = name, fs.open_input_file(inner)
            file.seek(offset)
            r = parse_record(zlib.decompress(file.read(length), 31))
            digest = r["WARC-Payload-Digest"].removeprefix("sha256:")
            body = r["payload"]
            if body is not None and hashlib.sha256(body).hexdigest() != digest:
                raise ValueError(f"the payload at {name}:{offset} doesn't match its digest")
            page, refers = (r.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
            rows.append((page, r["WARC-Target-URI"], int(r["X-Payload-Length"]) if body is None else len(body), digest, r["WARC-Type"], refers or None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ_TYPES, strict=True)], names=_READ_NAMES)
    if file is not None:
        file.close()


_READ_NAMES = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_READ_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]


def read_records(places: DataFrame) -> DataFrame:
    """page, url, payload_bytes, payload_digest, record_type, refers_to of each record of places
    (file, offset, length). Reads go through a file in order of offset, 16 MB of it at a
    stretch; places are written first, so that their bytes give the number of tasks. A record of any
    length is read whole; repeated places repeat, and none give no row."""
    spark = places.sparkSession
    places = written(places, "warc-places")
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 64_000_000 + 1)
    near = places.withColumn("part", F.floor(F.col("offset") / 16_000_000)).repartition(tasks, "file", "part").sortWithinPartitions("file", "offset")
    return near.mapInArrow(_read, "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")


ORACLE = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
