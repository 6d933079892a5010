"""WARC archives and their merged capture index (operator 10).

Each partition of captures becomes one archive of gzip-compressed records. Its index entries are sorted by URL key, timestamp and id in runs of a
bounded number, written as files of small blocks. Only the blocks' first keys become a table: from it come the ranges of keys, and
for each range the blocks that reach into it. A task merges its range with a loser tree over all runs, which holds one block of each.
While there are more than FAN runs, groups of them are merged into longer ones first. So the index is in
global order, every entry has its position in it, and records are read back through it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from itertools import groupby, islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialise, new_folder, partitions, slices, table
from .token_files import filesystem

# Fixed value of the WARC revisit profile.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST_CAPTURE = 1_704_067_200  # the second at which 2024 began
LEAST_REVISIT = 1000
#: Entries sorted at once, entries of a block, runs merged at once, and parts that a repeated payload's captures are dealt into.
RUN, LINES, FAN, SALTS = 100_000, 128, 512, 64
_ENTRY = "key string, stamp string, page_id long, path string, at long, length long"
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
_NAMES = ["key", "stamp", "page_id", "path", "at", "length"]
_BLOCK = "run string, block int, place long, size long, key string, stamp string, page_id long, last struct<key:string,stamp:string,page_id:long>"


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: host labels reversed, then path and query; no scheme, port 80 or 443, fragment or leading www."""
    try:
        parts = urlsplit((url or "").strip())
        host = re.sub(r"^www\d*\.", "", (parts.hostname or "").lower())
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return (url or "").lower()
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + query


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'capture:{page_id}')}>"


def record(page_id, url, payload: bytes, digest: str, stamp: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit of another capture without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {stamp}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or 'urn:unknown')}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http + (payload if refers_to is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names; http-length is that of the HTTP block) and payload; raises if a payload doesn't match its digest."""
    raw = gzip.decompress(member)
    head, rest = raw.split(b"\r\n\r\n", 1)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    fields["http-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
    return fields | {"sha1": digest}, payload


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner is replayed along one path."""

    def __init__(self, sources):
        self.sources = [iter(s) for s in sources]
        self.k = max(1, len(self.sources))
        self.heads = [next(s, None) for s in self.sources]
        self.tree = [-1] * self.k
        for i in range(len(self.sources)):
            self._replay(i)

    def _wins(self, a: int, b: int) -> bool:
        if a == -1 or b == -1:  # an open place wins until all have entered
            return a == -1
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if not self._wins(i, self.tree[node]):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.sources and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.sources[i], None)
            self._replay(i)


def captures(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Pages with digest, second and refers_to: of equal payloads of at least ``least`` bytes the greatest page_id is kept."""
    html = F.coalesce("html", F.lit(""))
    second = F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), second.alias("second"))
    large = F.octet_length("html") >= least
    last = rows.where(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    # Only payloads that repeat are joined; their captures are dealt by salt, as one payload may be that of many pages.
    last = last.where("last is not null and n > 1").select("digest", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("last")), None).otherwise(F.col("last"))
    seen = rows.where(large).withColumn("salt", salt).join(last, ["digest", "salt"], "left").withColumn("refers_to", refers)
    seen = seen.select("page_id", "url", "html", "digest", "second", "refers_to")
    return seen.unionByName(rows.where(~large).withColumn("refers_to", F.lit(None).cast("long")))


def _batch(rows: list[tuple], names: list[str], kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_run(uri: str, entries: Iterable[tuple]) -> Iterator[tuple]:
    """Writes sorted entries as blocks of LINES; yields run, block, place, size, the first key, stamp and id, and the last ones of each block."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    entries, at, k = iter(entries), 0, 0
    with fs.open_output_stream(path, compression=None) as out:
        while rows := list(islice(entries, LINES)):
            sink, batch = io.BytesIO(), _batch(rows, _NAMES, _KINDS)
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            raw = gzip.compress(sink.getvalue(), 1, mtime=0)
            out.write(raw)
            yield uri, k, at, len(raw), *rows[0][:3], dict(zip(("key", "stamp", "page_id"), rows[-1][:3], strict=True))
            at, k = at + len(raw), k + 1


def read_run(uri: str, blocks: list[tuple[int, int]], low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """The entries of some blocks (place, size) of a run, from ``low`` to before ``high``; one block is held at a time."""
    fs, path = filesystem(uri)
    for place, size in blocks:
        with fs.open_input_file(path) as file:
            file.seek(place)
            raw = gzip.decompress(file.read(size))
        batch = pa.ipc.open_stream(raw).read_all()
        for row in zip(*(batch.column(c).to_pylist() for c in _NAMES), strict=True):
            if high is not None and row[:3] >= high:
                return
            if low is None or row[:3] >= low:
                yield row


def _blocks(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["run", "block", "place", "size", "key", "stamp", "page_id", "last"]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.struct([("key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64())]))
    while held := list(islice(rows, 10_000)):
        yield _batch(held, names, kinds)


def write_archives(found: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per partition, and its index entries in sorted runs; returns the blocks of all runs.

    A task writes under names of its own attempt, and only blocks of successful attempts are in the result.
    """

    def write(batches):
        context = TaskContext.get()
        name = f"{folder}/capture-{context.partitionId():06d}-{context.taskAttemptId()}"
        out, at, entries, runs = None, 0, [], 0
        for batch in slices(batches):
            if out is None:
                fs, path = filesystem(f"{name}.warc.gz")
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "second", "refers_to")]
            for page_id, url, html, digest, second, refers_to in zip(*cols, strict=True):
                stamp = datetime.fromtimestamp(second, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                member = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, stamp, refers_to)
                out.write(member)
                entries.append((url_key(url), stamp, -1 if page_id is None else page_id, f"{name}.warc.gz", at, len(member)))
                at += len(member)
                if len(entries) == RUN:
                    yield from _blocks(write_run(f"{name}-{runs}.run", sorted(entries)))
                    entries, runs = [], runs + 1
        if out is not None:
            out.close()
            yield from _blocks(write_run(f"{name}-{runs}.run", sorted(entries)))

    return materialise(found.mapInArrow(write, _BLOCK), "runs")


def _fewer(blocks: DataFrame, folder: str) -> DataFrame:
    """Merges groups of FAN runs into one run each, until FAN are left at most."""
    while True:
        runs = blocks.select("run").distinct()
        n = runs.count()
        if n <= FAN:
            return blocks
        groups = -(-n // FAN)
        order = Window.partitionBy("half").orderBy("run")
        numbered = runs.withColumn("half", F.pmod(F.xxhash64("run"), F.lit(-(-groups // 64))))
        named = numbered.withColumn("group", F.concat_ws("-", "half", F.floor(F.row_number().over(order) / FAN).cast("string"))).select("run", "group")

        def merge(batches):
            for group, rows in groupby(((r["group"], r) for b in batches for r in b.to_pylist()), lambda x: x[0]):
                sources = [read_run(run, [(r["place"], r["size"]) for _, r in own]) for run, own in groupby(list(rows), lambda x: x[1]["run"])]
                yield from _blocks(write_run(f"{folder}/merged-{group}-{uuid.uuid4().hex}.run", LoserTree(sources)))

        placed = blocks.join(named, "run").select("group", "run", "block", "place", "size").repartition(partitions(blocks.sparkSession), "group")
        blocks = materialise(placed.sortWithinPartitions("group", "run", "block").mapInArrow(merge, _BLOCK), "runs")


def merge_runs(blocks: DataFrame, folder: str) -> DataFrame:
    """The entries of all runs with ``position``, 0, 1, ... in the order of URL key, timestamp and id over the whole index."""
    spark = blocks.sparkSession
    blocks, n = _fewer(blocks, folder), partitions(spark)
    first = F.struct("key", "stamp", "page_id")
    tops = blocks.repartitionByRange(n, "key", "stamp", "page_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min(first).alias("m"))
    cuts = sorted(tuple(r.m) for r in tops.collect())[1:]  # fewer than the partitions

    def deal(batches):
        for batch in batches:
            starts = [bisect_right(cuts, x) for x in zip(*(batch.column(c).to_pylist() for c in ("key", "stamp", "page_id")), strict=True)]
            ends = [bisect_right(cuts, (x["key"], x["stamp"], x["page_id"])) for x in batch.column("last").to_pylist()]
            spread = [(k, part) for k, (a, b) in enumerate(zip(starts, ends, strict=True)) for part in range(a, b + 1)]
            at, part = ([x[i] for x in spread] for i in (0, 1))
            rows = batch.select(["run", "block", "place", "size"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(part, pa.int32())], names=["run", "block", "place", "size", "part"])

    def merge(batches):
        held: dict[str, list] = {}
        part = 0
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["run"], []).append((r["place"], r["size"]))
                part = r["part"]
        low, high = cuts[part - 1] if part else None, cuts[part] if part < len(cuts) else None
        entries, line = iter(LoserTree([read_run(run, own, low, high) for run, own in held.items()])), 0
        while rows := list(islice(entries, 10_000)):
            yield _batch([(*r, part, line + k) for k, r in enumerate(rows)], [*_NAMES, "part", "line"], (*_KINDS, pa.int32(), pa.int64()))
            line += len(rows)

    dealt = blocks.mapInArrow(deal, "run string, block int, place long, size long, part int").repartitionById(max(n, len(cuts) + 1), "part")
    index = materialise(dealt.sortWithinPartitions("run", "block").mapInArrow(merge, _ENTRY + ", part int, line long"), "capture-index")
    counts = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    return index.join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn("position", F.col("before") + F.col("line")).drop("before", "line")


def read_archives(index: DataFrame) -> DataFrame:
    """Reads the record of every index entry; entries of one archive are read by one task, in order of their place."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_stamp", "position", "payload"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

    def read(batches):
        name, file = None, None
        for batch in batches:
            out, size = [], 0
            for path, at, length, *known in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "length", "key", "stamp", "position")), strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    fs, local = filesystem(path)
                    name, file = path, fs.open_input_file(local)
                file.seek(at)
                fields, payload = parse(file.read(length))
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                kind = fields["warc-type"]
                out.append((page and int(page), int(fields["http-length"]), fields["sha1"], kind, refers and int(refers), *known, payload if kind == "response" else None))
                size += len(payload)
                if size > 1 << 22:
                    yield _batch(out, names, kinds)
                    out, size = [], 0
            if out:
                yield _batch(out, names, kinds)
        if file is not None:
            file.close()

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, capture_stamp string, position long, payload binary"
    n = partitions(index.sparkSession)
    return index.repartition(n, "path").sortWithinPartitions("path", "at").mapInArrow(read, schema)


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes pages to archives; returns the merged index and the records read back through it.

    Null html is an empty payload, a null url becomes urn:unknown with an empty key, a null page_id is kept (and is never revisited);
    rows that repeat a page_id with one payload are responses each. A very long payload is held whole by its task, an empty table gives
    an empty index and no record. Extra columns are ignored.
    """
    folder = folder or new_folder(spark, "warc")
    index = merge_runs(write_archives(captures(pages), folder), folder)
    return index, read_archives(index)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages"))[1].drop("payload")


def op10_sql() -> str:
    """The same records in DuckDB's SQL, with their positions in the index."""
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
  regexp_extract(url, '^[a-z]+://(?:www[0-9]*[.])?([^/?#:]*)((?::[0-9]+)?)([^?#]*)((?:[?][^#]+)?)', ['host', 'port', 'path', 'query']) AS u,
  strftime(make_timestamp(CAST(({FIRST_CAPTURE} + coalesce(page_id, 0) % 1000000000) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS capture_stamp FROM pages),
k AS (SELECT *, array_to_string(list_reverse(string_split(lower(u.host), '.')), ',') || CASE WHEN u.port IN (':80', ':443') THEN '' ELSE u.port END || ')'
  || CASE WHEN u.path = '' THEN '/' ELSE u.path END || u.query AS url_key FROM p),
l AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, url_key, capture_stamp, row_number() OVER (ORDER BY url_key, capture_stamp, page_id) - 1 AS position FROM l"""
