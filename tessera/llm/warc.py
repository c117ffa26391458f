"""WARC archives and their globally ordered capture index.

``write_archives`` writes one gzip member per record into archive files of the
shared folder.  Of records with equal payloads of at least ``least`` bytes the
one with the largest page_id is the response, the others revisit it.
``read_archives`` parses the files back; the captures of each archive, sorted by
URL key, timestamp and page_id, are written as one run, a Parquet file of small
row groups.  ``merge_index`` is an external merge: the runs are cut at the same
keys into ranges, and the task of a range streams its slice of every run, a row
group at a time, through a loser tree.  A task holds one row group a run.  More
than ``FAN`` runs are merged into longer runs first, ``FAN`` at a time.

Files are written and read through pyarrow's file systems by URI, under a name
of its own for each task attempt, and a table names only files of attempts that
succeeded: a lost executor leaves at most an unnamed file.

Defined cases: null html is an empty payload, a null url an empty URL; rows with
a null page_id are left out; very long html is one record; equal page_ids stay,
as often as they occur, and compare as one record; equal keys keep the order of
their places in the archives; empty tables give empty results; other columns are
ignored, whatever their names.  Timestamps come from ``ts_col`` if given, else
page_id seconds after 2000-01-01.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, shuffle_parts, stored

FAR_IDS = 1_000_000  # revisits that may be broadcast; beyond, the join shuffles
ROLL = 256 << 20  # bytes of an archive file
FAN = 256  # runs merged at once
GROUP = 4096  # captures of a row group
KEYS = 20_000  # keys read to tell where to cut, at most; they only balance the tasks
HOT = 10_000  # records of one payload that are not joined by it
CAPTURE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, ts string, archive string, at long, size long"
_NAMES = [f.split()[0] for f in CAPTURE.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string()}
_SCHEMA = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in CAPTURE.split(", ")])
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, lower-cased; without scheme, port, fragment and a leading www."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    path = (parts.path or "/") + (f"?{'&'.join(sorted(parts.query.split('&')))}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}){path}".lower()


def record(page_id: int, url: str, ts: str, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    day = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {day}", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_IDENTICAL}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes, archive: str, at: int, size: int) -> tuple:
    """A capture row of one record; a response's payload is measured and its digest checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"{archive}:{at}: no WARC record")
    field = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest, kind = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"]
    if kind == "response" and (len(payload) != declared or base32_sha1(payload) != digest):
        raise ValueError(f"{archive}:{at}: the payload doesn't match its digest")
    number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
    ts = "".join(c for c in field["WARC-Date"] if c.isdigit())
    return (number(field["WARC-Record-ID"]), declared, digest, kind, number(field["WARC-Refers-To"]) if kind == "revisit" else None,
            url_key(field["WARC-Target-URI"]), ts, archive, at, size)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   ts_col: str | None = None, least: int = 0) -> DataFrame:
    """Writes the archives; the manifest, one row per file: path and records."""
    ts = (F.date_format(F.col(ts_col), "yyyyMMddHHmmss") if ts_col else
          F.date_format(F.timestamp_seconds(F.lit(946_684_800) + F.pmod(F.col(id_col).cast("long"), F.lit(3_000_000_000))), "yyyyMMddHHmmss"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
                        F.coalesce(ts, F.lit("20000101000000")).alias("ts"),
                        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload")).where("page_id IS NOT NULL")
    digests = stored(rows.where(F.length("payload") >= least).select("page_id", F.unhex(F.sha1("payload")).alias("digest")), "warc-digests")
    first = stored(digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "warc-payloads")
    hot = max(HOT, digests.count() // 10_000)  # at most 10,000 payloads occur so often
    few_payloads = F.broadcast(first.where(F.col("n") >= hot).drop("n"))
    rest = digests.join(few_payloads.select("digest"), "digest", "left_anti").join(first.where(F.col("n") < hot).drop("n"), "digest")
    revisits = digests.join(few_payloads, "digest").unionByName(rest).where("page_id <> refers_to").select("page_id", "digest", "refers_to")
    revisits = stored(revisits.distinct(), "warc-revisits")
    few = F.broadcast(revisits) if revisits.count() <= FAR_IDS else revisits
    keyed = rows.withColumn("digest", F.unhex(F.sha1("payload"))).join(few, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, path, count = fs.FileSystem.from_uri(folder), None, "", 0
        system, base = files
        done: list[tuple[str, int]] = []
        for b in batches:
            for page, url, ts, payload, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "ts", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(base, recursive=True)
                    path, count = f"{folder}/{name}", 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                out.write(gzip.compress(record(page, url, ts, payload, refers, base64.b32encode(digest).decode()), 1, mtime=0))
                count += 1
                if out.tell() > ROLL:
                    out.close()
                    out = None
                    done.append((path, count))
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return stored(keyed.select("page_id", "url", "ts", "payload", "digest", "refers_to").mapInArrow(run, "path string, records long"), "warc-manifest")


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, record) of each gzip member of a stream, in bounded memory."""
    offset, inflate, parts, size, rest = 0, zlib.decompressobj(31), [], 0, b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        parts.append(inflate.decompress(data))
        rest = inflate.unused_data
        size += len(data) - len(rest)
        if inflate.eof:
            yield offset, size, b"".join(parts)
            offset, inflate, parts, size = offset + size, zlib.decompressobj(31), [], 0


_RUN = "path string, rows long, keys array<struct<urlkey:string,ts:string,page_id:bigint>>"
_KEY = pa.struct([("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64())])


class _RunFile:
    """A run being written: sorted captures in row groups, under a name of its own."""

    def __init__(self, folder: str):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.parquet"
        self.path, self.rows, self.keys, self.held = f"{folder}/{name}", 0, [], []
        self.out = system.open_output_stream(f"{base}/{name}")
        self.writer = pq.ParquetWriter(self.out, _SCHEMA, compression="zstd")

    def add(self, row: tuple) -> None:
        self.held.append(row)
        if len(self.held) == GROUP:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.keys.append(dict(zip(("urlkey", "ts", "page_id"), _order(self.held[0]))))
            self.writer.write_batch(_batch(self.held), row_group_size=GROUP)
            self.rows, self.held = self.rows + len(self.held), []

    def close(self) -> pa.RecordBatch:
        """The run's row: its path, its captures, and the first key of each row group."""
        self._flush()
        self.writer.close()
        self.out.close()
        return pa.RecordBatch.from_arrays([pa.array([self.path], pa.string()), pa.array([self.rows], pa.int64()), pa.array([self.keys], pa.list_(_KEY))],
                                          names=["path", "rows", "keys"])


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The captures of each archive as a sorted run in ``folder``: one row per run, its path, rows and first keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, records in zip(b.column("path").to_pylist(), b.column("records").to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_stream(name, compression=None) as stream:
                    rows = [parse(raw, path, at, size) for at, size, raw in members(stream)]
                if len(rows) != records:
                    raise ValueError(f"{path}: {len(rows)} records of {records}")
                rows.sort(key=_order)  # an archive is at most ROLL bytes and a record
                out = _RunFile(folder)
                for row in rows:
                    out.add(row)
                yield out.close()

    n = max(1, min(manifest.count(), shuffle_parts(manifest.sparkSession)))
    return stored(manifest.repartition(n).mapInArrow(run, _RUN), "warc-runs")


def _order(row: tuple) -> tuple:
    return row[5], row[6], row[0], row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def loser_tree(runs: list[Iterator], key: Callable) -> Iterator:
    """Merges sorted iterators through a tree of losers: one comparison a level for each item."""
    k = len(runs)
    if not k:
        return
    end = object()
    items = [next(r, end) for r in runs]
    keys = [None if x is end else key(x) for x in items]

    def beats(a: int, b: int) -> bool:
        """Whether run a's item goes before run b's; ended runs go last, ties by run."""
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    tree = [-1] * (2 * k)
    tree[k:] = range(k)
    losers = [0] * k
    for node in range(k - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    winner = tree[1] if k > 1 else 0
    while keys[winner] is not None:
        yield items[winner]
        items[winner] = x = next(runs[winner], end)
        keys[winner] = None if x is end else key(x)
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def _span(group) -> tuple[tuple, tuple]:
    """Bounds of the first parts of all keys of a row group, as far as its statistics tell."""
    low, high = (), ()
    for name in ("urlkey", "ts", "page_id"):
        stats = group.column(_NAMES.index(name)).statistics
        if stats is None or not stats.has_min_max:
            break
        low, high = (*low, stats.min), (*high, stats.max)
        if stats.min != stats.max:
            break
    return low, high


def _slice(path: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The captures of a run with low <= key < high, streamed from the row groups that may hold some."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        table = pq.ParquetFile(file)
        for k in range(table.num_row_groups):
            first, last = _span(table.metadata.row_group(k))
            if low is not None and last < low[: len(last)]:
                continue
            if high is not None and first > high[: len(first)]:
                return
            for batch in table.iter_batches(batch_size=256, row_groups=[k]):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = _order(row)
                    if high is not None and key >= high:
                        return
                    if low is None or key >= low:
                        yield row


def _cuts(runs: DataFrame, many: int) -> list[tuple]:
    """Keys that cut the captures into about ``many`` equal ranges, from the first keys of row groups (of some, if there are very many)."""
    keys = runs.select(F.explode("keys").alias("key"))
    n = keys.count()
    if n > KEYS:
        keys = keys.where(F.pmod(F.xxhash64("key"), F.lit(-(-n // KEYS))) == 0)
    some = sorted(tuple(r["key"]) for r in keys.collect())
    return sorted({some[i * len(some) // many] for i in range(1, many)}) if some else []


def _merged(runs: list[str], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    return loser_tree([_slice(p, low, high) for p in runs], _order)


def merge_runs(runs: DataFrame, folder: str, fan: int = FAN) -> DataFrame:
    """``runs`` as at most ``fan`` sorted runs, by passes that merge ``fan`` runs into one."""
    while (many := runs.count()) > fan:
        some = runs.select(F.pmod(F.xxhash64("path"), F.lit(-(-many * 3 // (2 * fan)))).alias("heap"), "path")
        heaps = some.groupBy("heap").agg(F.sort_array(F.collect_list("path")).alias("paths"))  # about two thirds of ``fan`` paths each

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for paths in b.column("paths").to_pylist():
                    out = _RunFile(folder)
                    for row in _merged(paths, None, None):
                        out.add(row)
                    yield out.close()

        runs = stored(heaps.mapInArrow(run, _RUN), "warc-runs")
    return runs


def merge_index(runs: DataFrame, folder: str, fan: int = FAN) -> DataFrame:
    """The capture history in global order of (urlkey, ts, page_id): partitions hold ascending key ranges."""
    spark = runs.sparkSession
    runs = merge_runs(runs, folder, fan)
    paths = sorted(r["path"] for r in runs.select("path").collect())  # at most ``fan``
    total = runs.agg(F.sum("rows")).first()[0] or 0
    cuts = _cuts(runs, max(1, min(shuffle_parts(spark), total // (4 * GROUP))))
    edges = [None, *cuts, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                out: list[tuple] = []
                for row in _merged(paths, edges[k], edges[k + 1]):
                    out.append(row)
                    if len(out) == GROUP:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    return spark.range(0, len(edges) - 1, 1, len(edges) - 1).mapInArrow(run, CAPTURE)


def round_trip(pages: DataFrame, fan: int = FAN, **columns) -> DataFrame:
    """Pages written as archives, read back, and indexed: one capture row per page, in global order."""
    spark = pages.sparkSession
    runs = read_archives(write_archives(pages, fresh_path(spark, "warc"), **columns), fresh_path(spark, "warc-run-files"))
    return merge_index(runs, fresh_path(spark, "warc-run-files"), fan)
