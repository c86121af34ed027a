"""WARC archives with payload deduplication, and their merged capture index.

Writing: each page becomes one record of a WARC/1.1 file. Of equal payloads of
at least ``least_bytes`` the one with the largest id is stored, the others
become ``revisit`` records that refer to it. A record is one gzip member, so a
reader can seek to it by the offset and length of the index. Members are
bundled to archives of bounded size; Spark's text writer writes each to a file
of its own, so tasks can fail and be repeated, and any file system of Spark's
will do.

Reading: archives are parsed member by member; every stored payload is checked
against its digest. The records of a file, sorted by url key and time, are a
run of the index. Runs are cut at common key bounds by a range shuffle; in
each range the k pieces of runs are merged with a loser tree, so that the
ranges one after the other hold the capture histories in global order. A range
holds about ``RANGE_ROWS`` index rows, whatever keys repeat: file and offset
tell equal keys apart.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, shuffle_partitions
from tessera.sources.staging import stage

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stored payloads of which there are copies, up to this number (a digest and an id each), are broadcast.
BROADCAST_COPIES = 500_000
#: Index rows of one merge range, about.
RANGE_ROWS = 100_000
#: An archive is closed when it holds this number of bytes; it is larger by one record at most.
FILE_BYTES = 32 << 20
#: A gzip member without content. It ends with a zero byte, as does every member of less than 16 MB.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
ENTRY = ("urlkey string, timestamp string, page_id long, record_type string, refers_to long, payload_bytes long, "
         "payload_digest string, url string, file string, offset long, length long")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, time: Column, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            least_bytes: int = 1000) -> DataFrame:
    """One column ``value``: the WARC record of each page. Null payloads count
    as empty, a null url has no target header, a null id an empty record id."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), time.alias("time"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload")) \
        .withColumn("n", F.octet_length("payload").cast("long")).withColumn("digest", F.unhex(F.sha1("payload")))
    copies = stage(rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(
        F.max("id").alias("stored"), F.count(F.lit(1)).alias("c")).where("c > 1 and stored is not null").drop("c"),
        "warc-copies")
    if copies.count() <= BROADCAST_COPIES:
        copies = F.broadcast(copies)
    rows = rows.join(copies, "digest", "left").withColumn(
        "again", F.col("stored").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("stored"))))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
                    _header("Content-Length", F.col("n").cast("string")), F.lit(CRLF))
    block = F.concat(http, F.when(F.col("again"), F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(F.col("again"), F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", _urn(F.col("id"))),
        _header("WARC-Date", F.date_format(F.coalesce("time", F.timestamp_seconds(F.lit(0))),
                                           "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("digest")))),
        _header("WARC-Profile", F.when(F.col("again"), F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(F.col("again"), _urn(F.col("stored")))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _header("Content-Length", F.octet_length(block).cast("string")))
    return rows.select(F.concat(head, F.lit(CRLF), block).alias("value"))


def _bundles(file_bytes: int):
    def bundle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0

        def closed() -> pa.RecordBatch:
            if members[-1][-1]:
                members.append(EMPTY_MEMBER)
            # the line separator gives the last zero byte back
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for value in batch.column(0):
                members.append(gzip.compress(value.as_buffer().to_pybytes() + (CRLF * 2).encode(), 6, mtime=0))
                size += len(members[-1])
                if size >= file_bytes:
                    yield closed()
                    members, size = [], 0
        if members:
            yield closed()

    return bundle


def write(pages: DataFrame, path: str, time: Column, file_bytes: int = FILE_BYTES, **columns) -> None:
    """Write archives of about ``file_bytes`` to ``path``: one gzip member a
    record, at least one record a file. The files have the text writer's names."""
    packed = records(pages, time, **columns).mapInArrow(_bundles(file_bytes), "value binary")
    packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0") \
        .option("maxRecordsPerFile", 1).text(path)


class _Stream:
    """Bytes of the gzip members of an archive, unpacked as they are asked for.
    ``at`` is the place in the archive where the member being read begins."""

    def __init__(self, packed: bytes):
        self.packed, self.next, self.at = memoryview(packed), 0, 0

    def _more(self) -> bool:
        if self.unpack.eof or self.next >= len(self.packed):
            return False
        part = self.packed[self.next:self.next + (1 << 16)]
        self.ready += self.unpack.decompress(part)
        self.next += len(part) - len(self.unpack.unused_data)
        return True

    def member(self) -> bool:
        """Go to the next member that holds something; False at the end."""
        while self.next < len(self.packed):
            self.unpack, self.at, self.ready = zlib.decompressobj(31), self.next, bytearray()
            while not self.ready and self._more():
                pass
            if self.ready:
                return True
            self.close()
        return False

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with ``mark``."""
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not self._more():
                raise ValueError("the archive ends inside a record")
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def close(self) -> int:
        """Read to the end of the member; its packed length."""
        while self._more():
            pass
        if not self.unpack.eof:
            raise ValueError("the archive ends inside a record")
        if self.ready:
            raise ValueError("bytes are left in a member after its record")
        return self.next - self.at


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split(CRLF)[1:]
    return {k.lower(): v[1:] for k, _, v in (x.partition(":") for x in lines if x)}


def _id(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def url_key(url: str | None) -> str:
    """Sort-friendly form of a url: host labels from the right, then the path
    and query, in lower case; empty for null."""
    rest = (url or "").partition("://")[2] or (url or "")
    host, slash, path = rest.partition("#")[0].partition("/")
    return (",".join(reversed(host.split("."))) + ")" + slash + path).lower() if url else ""


def parse(packed: bytes, file: str) -> Iterator[tuple]:
    """Index entries (as in ``ENTRY``) of one archive, in file order; ``offset``
    and ``length`` are those of the record's gzip member in the file. Raises if
    a stored payload doesn't match its digest or length."""
    stream = _Stream(packed)
    while stream.member():
        f = _fields(stream.until((CRLF * 2).encode()))
        block = stream.take(int(f["content-length"]))
        if stream.take(4) != (CRLF * 2).encode():
            raise ValueError(f"no record end in the member at byte {stream.at} of {file}")
        http, _, payload = block.partition((CRLF * 2).encode())
        n, digest = int(_fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
        if f["warc-type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged payload in the member at byte {stream.at} of {file}")
        url, length = f.get("warc-target-uri"), stream.close()
        yield (url_key(url), f["warc-date"], _id(f["warc-record-id"]), f["warc-type"], _id(f.get("warc-refers-to")),
               n, digest, url, file, stream.at, length)


def loser_tree(runs: list[list]) -> Iterator:
    """Merge sorted runs. Each inner node keeps the loser of the match played
    there, so the next item costs one match a level. Equal items come in the
    order of their runs."""
    k = len(runs)
    iters = [iter(r) for r in runs]
    heads = [next(i, None) for i in iters]
    losers = [-1] * max(1, k)

    def before(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    def play(leaf: int) -> None:
        winner, node = leaf, (leaf + k) // 2
        while node:
            if losers[node] < 0:
                losers[node] = winner
                return
            if before(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2
        losers[0] = winner

    for leaf in range(k):
        play(leaf)
    while k and heads[losers[0]] is not None:
        top = losers[0]
        yield heads[top]
        heads[top] = next(iters[top], None)
        play(top)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of all archives in ``path``: ``ENTRY`` with ``range``,
    ``seq`` (in the range, from 0) and ``position`` (in the whole index, from 1):
    captures in order of url key, time and id (null first); of equal ones, in
    order of file and offset."""

    def runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in ENTRY.split(", ")]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                own = sorted(parse(content, file), key=_order)
                yield pd.DataFrame(own, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    entries = stage(archives.mapInPandas(runs, ENTRY), "warc-runs")
    ranges = max(shuffle_partitions(spark), -(-entries.count() // RANGE_ROWS))
    cut = entries.repartitionByRange(ranges, "urlkey", "timestamp", "page_id", "file", "offset") \
        .sortWithinPartitions("file", "urlkey", "timestamp", "page_id", "offset")

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # one range
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True).astype({"page_id": "Int64", "refers_to": "Int64"})
        keys = [(*_order(r), *r[3:]) for r in
                rows[["urlkey", "timestamp", "page_id", "file", "offset"]].itertuples(index=False, name=None)]
        pieces = [[(keys[k], k) for k in at] for at in rows.groupby("file", sort=True).indices.values()]
        out = rows.iloc[[k for _, k in loser_tree(pieces)]]
        yield out.assign(range=TaskContext.get().partitionId(), seq=range(len(out)))

    merged = stage(cut.mapInPandas(merge, ENTRY + ", range int, seq long"), "warc-index")
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return merged.join(F.broadcast(starts), "range") \
        .select(*merged.columns, (F.col("start") + F.col("seq") + 1).alias("position"))


def _order(entry: tuple) -> tuple:
    key, time, page = entry[:3]
    known = page is not None and not pd.isna(page)
    return key, time, known, int(page) if known else 0


def archive_and_index(pages: DataFrame, time: Column, **columns) -> DataFrame:
    """Write archives into the shared folder, read them back, return their
    merged index (see ``read_index``). Rows that repeat an id and a payload are
    equal records: if their id is the largest, all of them are stored."""
    path = f"{ensure_checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, time, **columns)
    return read_index(pages.sparkSession, path)
