"""WARC archives and their capture index.

Archives are WARC/1.1 with every record a gzip member of its own, so that a capture is read by its offset alone. They
are written by Spark's text sink: a row is an archive, at most ARCHIVE_BYTES long but for a single record that is longer
(an empty gzip member stands as line separator), so they may live in any file system that Spark reaches, and are read
back as binary files. The sink is handed the bytes as a string: it writes the bytes of a string as they are, whether
they are UTF-8 or not, and the tests hold each record against its bytes by offset.

Each archive yields a run: its captures sorted by (URL key, timestamp, page) where it is parsed, stored with their place
in the run. Runs are dealt by range of that key into ranges of about RANGE_ROWS captures, whatever the size of the
input; in a range the parts of the runs come in run order, by place alone, and a loser tree merges them. Partition after
partition gives the global capture history. The page number is part of the key, so one URL with a third of all captures
is split.

Which of equal payloads is the response is decided on (digest, page) alone. Payloads travel once, compressed; within a
batch only those of the largest page of a digest do, as the others are revisits in any case.

Nulls and ties: a null payload is empty; a null URL has the empty URL key and no target header; of records with
equal payloads the largest page_id is the response (null ids come last; rows that repeat that page_id are responses
as well); an empty table gives an empty history. Other columns of the input are ignored. A payload over ARCHIVE_BYTES
has an archive to itself. A page without a capture time takes one from its id, modulo SPAN seconds, so any long gives a
time of four-digit years, in whose text order is time order. Line breaks in a URL are percent-encoded, in the archive
and thus in its key.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvetrail.llm.common import drop_path, materialize, pieces, salted_join, scratch_path

#: Bytes of an archive: it bounds what one task reads back at a time.
ARCHIVE_BYTES = 32 << 20
#: Captures of a range of the merge, about.
RANGE_ROWS = 100_000
#: Capture times of pages that have none: seconds after EPOCH, fewer than SPAN.
EPOCH, SPAN = 1_700_000_000, 1_000_000_000
#: gzip level of records.
LEVEL = 6

#: An empty gzip member.
_EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)

RUN_SCHEMA = (
    "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, archive string, place long, record_offset long, record_bytes long"
)
_NAMES = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
_KINDS = [pa.string() if c.endswith("string") else pa.int64() for c in RUN_SCHEMA.split(", ")]


def url_key(url: str | None) -> str:
    """Host labels from the right, then port, path and query: com,example,www)/path."""
    if url is None:
        return ""
    found = re.match(r"[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)(.*)", url, re.DOTALL)
    if not found or not (found[1] or found[2]):
        return url
    return ",".join(reversed(found[1].lower().split("."))) + ")" + found[2]


# ---------------------------------------------------------------- writing


def _packed(min_bytes: int):
    """Digest, size and compressed payload of each capture; a payload that another of the batch has for sure stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            pages = batch.column(0).to_pylist()
            bodies = [x.as_py() or b"" for x in batch.column(2)]
            digests = [hashlib.sha1(b).hexdigest() for b in bodies]
            top: dict[str, int] = {}
            for page, digest, body in zip(pages, digests, bodies):
                if page is not None and len(body) >= min_bytes:
                    top[digest] = max(page, top.get(digest, page))
            packed = [zlib.compress(b, LEVEL) if d not in top or top[d] == p else None for p, d, b in zip(pages, digests, bodies)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(digests), pa.array([len(b) for b in bodies], pa.int64()), pa.array(packed, pa.binary())],
                names=["page_id", "url", "captured", "digest", "size", "packed"],
            )

    return run


def _line(name: str, value: object) -> str:
    return f"{name}: {value}\r\n"


def _ident(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, captured: str | None, digest: str, size: int, payload: bytes | None, kept: int | None) -> bytes:
    """One record. kept: the page of the response that it revisits; its payload is not stored then."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = "WARC/1.1\r\n" + _line("WARC-Type", "revisit" if revisit else "response") + _line("WARC-Record-ID", _ident(page))
    head += _line("WARC-Date", captured or "1970-01-01T00:00:00Z")
    if url is not None:
        head += _line("WARC-Target-URI", re.sub(r"[\r\n]", lambda c: f"%{ord(c[0]):02X}", url))
    if revisit:
        head += _line("WARC-Refers-To", _ident(kept)) + _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    head += _line("Content-Type", "application/http; msgtype=response") + _line("Content-Length", len(http) + (0 if revisit else size)) + "\r\n"
    return b"".join([head.encode("utf-8", "replace"), http, payload or b"", b"\r\n\r\n"])


def _member(data: bytes) -> bytes:
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


def _archives(archive_bytes: int, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["archive"])
        for batch in pieces(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page, url, captured, digest, n, packed, kept = row
                revisit = kept is not None and kept != page and n >= min_bytes
                member = _member(record(page, url, captured, digest, n, None if revisit else zlib.decompress(packed), kept))
                if held and size + len(member) > archive_bytes:
                    yield out(held)
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield out(held)

    return run


def write_archives(
    captures: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None,
    min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Writes one record per row. Of equal payloads of at least min_bytes only the response stores the payload."""
    when = captured if captured is not None else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col(page).cast("long"), F.lit(0).cast("long")), F.lit(SPAN)))
    rows = captures.select(
        F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    # digests and pages alone decide; counts and largest pages are summed before they are shuffled
    facts = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("size")).where(F.col("size") >= min_bytes)
    chosen = facts.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1").select("digest", "kept")
    packed = rows.mapInArrow(_packed(min_bytes), "page_id long, url string, captured string, digest string, size long, packed binary")
    met = salted_join(packed, chosen, ["digest"], F.struct("page_id", "url")).select("page_id", "url", "captured", "digest", "size", "packed", "kept")
    files = met.mapInArrow(_archives(archive_bytes, min_bytes), "archive binary").select(F.col("archive").cast("string"))
    files.write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


# ---------------------------------------------------------------- reading


def read_members(data: bytes, step: int = 1 << 16) -> Iterator[tuple[bytes, int, int]]:
    """Each gzip member that is not empty: what it holds, its offset and its length."""
    at = 0
    while at < len(data):
        coder, parts, end = zlib.decompressobj(31), [], at
        while not coder.eof:
            if end >= len(data):
                raise ValueError(f"the member at byte {at} has no end")
            parts.append(coder.decompress(data[end : end + step]))
            end = min(end + step, len(data)) - len(coder.unused_data)
        if content := b"".join(parts):
            yield content, at, end - at
        at = end


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record. The length comes from the headers, so a payload may hold anything."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("no record")
    headers = {k.decode().lower(): v.decode("utf-8", "replace") for k, _, v in (x.partition(b": ") for x in lines[1:])}
    return headers, data[end + 4 : end + 4 + int(headers["content-length"])]


def _page(ident: str | None) -> int | None:
    body = (ident or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body not in ("", "none") else None


def capture_of(data: bytes) -> tuple:
    """URL key, timestamp, page, payload bytes, payload digest, record type and page referred to of one record."""
    headers, block = read_record(data)
    kind, (http, _, payload) = headers["warc-type"], block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        n = len(payload)
        if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
            raise ValueError(f"a payload of {headers['warc-record-id']} does not fit its digest")
    else:
        n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    return url_key(headers.get("warc-target-uri")), headers["warc-date"], _page(headers["warc-record-id"]), n, digest, kind, _page(headers.get("warc-refers-to"))


def _before_null(page: int | None) -> int:
    return -(1 << 63) - 1 if page is None else page


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of each archive."""
    for batch in pieces(batches, rows=1):
        name = batch.column(0)[0].as_py()
        run = [(*capture_of(data), at, size) for data, at, size in read_members(batch.column(1)[0].as_py())]
        run.sort(key=lambda c: (c[0], c[1], _before_null(c[2])))
        for at in range(0, len(run), 10_000):
            part = run[at : at + 10_000]
            cols = [list(c) for c in zip(*part)]
            cols[7:7] = [[name] * len(part), list(range(at, at + len(part)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """Reads archives back: captures with their place in the sorted run of their archive."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_index, RUN_SCHEMA)


class LoserTree:
    """Merges k sorted runs. Inner nodes keep the loser of their match, so a pop replays one path of log2(k) matches.
    A run is a list of keys; equal keys come in the order of the runs."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        x, y = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # still building: wait here for the other side
                self.tree[node] = winner
                return
            if self._before(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        while self.k and self.at[self.tree[0]] < len(self.runs[self.tree[0]]):
            run = self.tree[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._replay(run)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches hold the parts of runs of one range one after another, each in its order; gives them merged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    archive = table.column("archive").to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.concatenate([[True], archive[1:] != archive[:-1]]))
    keys = list(zip(table.column("url_key").to_pylist(), table.column("captured").to_pylist(), map(_before_null, table.column("page_id").to_pylist())))
    order: list[int] = []
    for run, at in LoserTree([keys[a:b] for a, b in zip(cuts, [*cuts[1:], len(keys)])]):
        order.append(int(cuts[run]) + at)
        if len(order) == 10_000:
            yield from table.take(pa.array(order)).combine_chunks().to_batches()
            order = []
    if order:
        yield from table.take(pa.array(order)).combine_chunks().to_batches()


def merge_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Runs of archives (a table, read twice) to one capture history in global order of (URL key, timestamp, page)."""
    ranges = -(-max(1, runs.count()) // range_rows)
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id").sortWithinPartitions("archive", "place")
    return dealt.mapInArrow(_merge, RUN_SCHEMA)


def capture_history(captures: DataFrame, path: str | None = None, range_rows: int = RANGE_ROWS, **options) -> DataFrame:
    """Writes archives of all captures, reads them back, and merges their runs. Archives without a path of their own go
    when they are indexed."""
    spark = captures.sparkSession
    where = path or scratch_path(spark, "warc")
    write_archives(captures, where, **options)
    runs = materialize(index_runs(spark, where), "warc-runs")
    if path is None:
        drop_path(spark, where)
    return merge_index(runs, range_rows)
