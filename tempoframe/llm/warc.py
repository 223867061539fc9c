"""WARC archives of pages, and their capture index by an external merge.

Writing: each page becomes one record, gzipped by itself. Of equal payloads of at least ``least`` bytes the page with
the largest id is written as a response, the others as revisits that name it and keep only the HTTP head. Each task
writes the archives of its own partition and lists them in a manifest; only archives that it names are read, with the
number of records that it gives.

Reading: each archive is read whole and gives a capture run, sorted by URL key, time and page. The runs are dealt by
ranges of that order, ``RANGE_ROWS`` captures in each, about, however many there are; in each range a loser tree merges the
runs' parts, so that the ranges one after the other are the capture history of all archives.

Defined cases: null html is the empty payload; null or odd URLs have the key of what can be read of them; rows that
repeat with the same page and payload are records each, of the same type; a null ``page_id`` is the smallest; an empty
table writes no archive and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempoframe.llm.files import dealt_files, new_name, read_file, write_file
from tempoframe.llm.shared import bounded_batches, shared_folder, staged

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of equal payloads are broadcast up to this number (two digests and an id each), else joined by shuffling.
BROADCAST_ROWS = 200_000
#: Captures that one task merges, about: they and their keys are in its memory.
RANGE_ROWS = 100_000
CAPTURE = "url_key string, captured string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long, length long"
ORDER = ["url_key", "captured", "page_id"]


def url_key(url: str) -> str:
    """Host labels from last to first, then path and sorted query, in lower case."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    port_text = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port_text}){(parts.path or '/').lower()}{query}"


def capture_time(page_id: int | None) -> datetime:
    """The pages have no time of their own: a second for each id, within a century."""
    return EPOCH + timedelta(seconds=(page_id or 0) % (100 * 365 * 86400))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record with its head; digest: SHA-1 in hexadecimal."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", capture_time(page_id).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("WARC-Target-URI", " ".join(url.split())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", capture_time(refers_to).strftime("%Y-%m-%dT%H:%M:%SZ")), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def squeezed(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def warc_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """offset, length, fields (names in lower case) and block of each record of an archive of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(view):
                raise ValueError("an archive ends inside a record")
            piece = view[end : end + (1 << 16)]
            parts.append(z.decompress(piece))
            end += len(piece) - len(z.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield at, end - at, fields, rest[: int(fields["content-length"])]
        at = end


def decided(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, keep (the page that stays of a group of equal payloads, else null), grouped."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "check": F.sha2("payload", 256)})
    large = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest", "check")
    groups = staged(large.groupBy("digest", "check").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "check", "keep", F.lit(True).alias("grouped")))
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups) if few else groups, ["digest", "check"], "left").select("page_id", "url", "payload", "digest", "keep", F.coalesce("grouped", F.lit(False)).alias("grouped"))


def write_archives(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes archives below ``folder`` (a URI); returns their manifest, a written table of name, records, bytes."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, records, held = 0, 0, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal number, size, records, held
            name = new_name("pages", number, "warc.gz")
            data = b"".join(held)
            write_file(folder, name, data)
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([len(data)], pa.int64())], ["name", "records", "bytes"])
            number, size, records, held = number + 1, 0, 0, []
            return row

        for b in batches:
            for page, url, payload, digest, keep, grouped in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + len(payload) > archive_bytes:
                    yield flush()
                held.append(squeezed(warc_record(page, url, payload, digest, keep, grouped and page != keep)))
                size, records = size + len(payload) + 1000, records + 1
        if held:
            yield flush()

    return staged(decided(pages, least).mapInArrow(run, "name string, records long, bytes long"))


def capture_runs(folder: str, manifest: DataFrame) -> DataFrame:
    """The captures of each archive of the manifest, sorted by ORDER; payload length and digest are those of the stored payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for offset, length, f, block in warc_records(read_file(folder, name)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    page = int(f["x-page-id"]) if f["x-page-id"] else None
                    named = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    refers = f.get("x-refers-to-page-id") or None
                    if f["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != named):
                        raise ValueError(f"{name} at {offset}: the payload is not what its head says")
                    rows.append((url_key(f["warc-target-uri"]), f["warc-date"], page, f["warc-target-uri"], f["warc-type"], size, named, refers and int(refers), name, offset, length))
                if len(rows) != records:
                    raise ValueError(f"{name}: {len(rows)} records, {records} in the manifest")
                rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], r[9]))
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = [c.split()[0] for c in CAPTURE.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt_files(manifest.select("name", "records")).mapInArrow(run, CAPTURE)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that a new head replays one path."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        self.winner = -1
        for i in range(self.k):
            self._seed(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _seed(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])
            node = (i + self.k) // 2
            while node > 0:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merged_captures(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of all runs, each partition in ORDER and before the next."""
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, *ORDER, "archive", "offset").sortWithinPartitions("archive", *ORDER, "offset")  # each run's part by itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        columns = [table.column(c) for c in ORDER]
        archive = table.column("archive")
        cuts = [0, *np.flatnonzero(pc.not_equal(archive.slice(1), archive.slice(0, len(archive) - 1)).to_numpy()) + 1, len(archive)]
        parts = [iter(range(i, j)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

        def key(i: int) -> tuple:
            url, captured, page = (c[i].as_py() for c in columns)
            return url, captured, -1 if page is None else page

        order: list[int] = []
        for i in LoserTree(parts, key):
            order.append(i)
            if len(order) == 10_000:
                yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches()
                order = []
        if order:
            yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches()

    return dealt.mapInArrow(run, CAPTURE)


def warc_captures(pages: DataFrame, folder: str | None = None, least: int = 1000, archive_bytes: int = 32 << 20, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Writes the archives, reads them back and merges their runs; columns of CAPTURE."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    manifest = write_archives(pages, folder, least, archive_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], CAPTURE)
    return merged_captures(staged(capture_runs(folder, manifest)), range_rows)
