"""Exact repeated passages by suffix sorting (operator 9).

Every passage of ``size`` bytes that starts at two or more places of the corpus
marks the bytes it covers.  Sorting all suffixes would move each byte of text
many times over, so suffixes that cannot repeat are put aside first, exactly, and those that repeat together go as one row:

* Each window of ``size`` bytes has one *anchor*: the K-byte string in it of least
  hash (leftmost if tied).  Equal windows have equal anchors at equal offsets,
  so a window whose anchor string is unique in the corpus cannot repeat.
* Consecutive windows with one anchor form a *run*, a packed row of suffixes with two leading tokens: the anchor and the
  whole *hull* of the run.  Runs are range-partitioned by their tokens, each bucket is sorted and neighbours are compared. Equal
  runs repeat in all their windows; runs alone with their anchor can't repeat.
* The other runs are unpacked, with one representative of each repeated run of their anchor: each suffix has two tokens,
  the hashes of its first BLOCK bytes and of the rest up to ``size``.  They are range-partitioned, sorted and compared likewise.

Splitters are sampled by Spark from leading tokens and, as the last part of the key, places: so a passage that is everywhere is dealt over many buckets.
Each bucket is sorted by multikey quicksort, and the first and last suffix of each bucket are compared with those of the others.
Equal runs and windows within one batch of texts are combined before any shuffle. Runs at the ends of a bucket are always
unpacked, as their bucket can't tell that they are alone.

Equality is that of hashes: 128 bits of a run, 96 bits of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import Buffer, as_bytes, chunks, mix
from .scratch import drop, free, materialise, partitions, row_key, slices

K = 50
BLOCK = 100
_ANCHORS = "rid long, start int, n int, anchor long, hull long, weight int"
_SUFFIXES = "rid long, n int, t1 long, rest long"


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by prefix and suffix minima of blocks of w."""
    m = len(h) - w + 1
    rows = np.concatenate([h, np.full(-len(h) % w, ~np.uint64(0))]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def _intervals(buf: Buffer, size: int) -> tuple[np.ndarray, ...]:
    """Intervals [lo, hi] of window starts that share an anchor: text number, lo, hi, anchor hash, hull hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(buf.bytes) < size:
        return none
    h, w = buf.windows(K), size - K + 1
    least = _sliding_min(h, w)
    owner = np.searchsorted(buf.ends, np.arange(len(least)), side="right") - 1
    whole = np.arange(len(least)) + size <= buf.ends[owner + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(least)) - 1
    lo, hi = lo[whole[lo]], hi[whole[lo]]
    if not len(lo):
        return none
    at = np.lib.stride_tricks.sliding_window_view(h, w)[lo].argmin(1) + lo
    tied = np.flatnonzero(at < hi)  # a later window has the next place of the same least hash as its anchor
    if len(tied):
        los, his, ats = [lo], [hi.copy()], [at]
        his[0][tied] = at[tied]
        for t in tied:
            q = np.flatnonzero(h[at[t] + 1 : hi[t] + w] == h[at[t]]) + at[t] + 1
            a = np.concatenate([at[t : t + 1], q[:-1]]) + 1
            keep = a <= hi[t]
            los.append(a[keep])
            his.append(np.minimum(q, hi[t])[keep])
            ats.append(q[keep])
        lo, hi, at = np.concatenate(los), np.concatenate(his), np.concatenate(ats)
    hull = mix(buf.ranges(lo, hi + size) ^ (at - lo).astype(np.uint64))
    return owner[lo], lo, hi, h[at], hull


def _spans(rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the byte ranges of each text."""
    order = np.lexsort((start, rid))
    rid, start, end = rid[order], start[order], end[order]
    if not len(rid):
        return rid, start, end
    text = np.concatenate([[0], np.cumsum(rid[1:] != rid[:-1])])
    top = int(end.max()) + 1
    reach = np.maximum.accumulate(end + text * top) - text * top
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return rid[at], start[at], reach[np.append(at[1:], len(rid)) - 1]


def _combine(rid, start, n, first, second, size):
    """Within a batch: ranges that repeat here, as spans; and one weighted row of each distinct key."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.cumsum(new) - 1
    count = np.bincount(group) if len(a) else np.zeros(0, np.int64)
    keep = order[new]
    again = order[count[group] > 1] if len(a) else order
    spans = _spans(rid[again], start[again].astype(np.int64), start[again].astype(np.int64) + n[again] - 1 + size)
    return spans, keep, np.minimum(count, 2)


def _rows(spans, rid, start, n, first, second, weight, names) -> pa.RecordBatch:
    """Spans found so far (weight 0) and keyed rows in one batch."""
    z = np.zeros(len(spans[0]), np.int64)
    i64 = lambda x: np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
    cols = [
        np.concatenate([spans[0], rid]).astype(np.int64),
        np.concatenate([spans[1], start]).astype(np.int32),
        np.concatenate([spans[2] - spans[1], n]).astype(np.int32),
        np.concatenate([i64(spans[0]), i64(first)]),
        np.concatenate([z, i64(second)]),
        np.concatenate([z, weight]).astype(np.int32),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids = batch.column("rid").to_numpy(zero_copy_only=False)
        texts = as_bytes(batch.column("text").to_pylist())
        parts = []
        for a, b in chunks(texts):
            buf = Buffer(texts[a:b])
            owner, lo, hi, anchor, hull = _intervals(buf, size)
            parts.append((rids[a + owner], lo - buf.ends[owner], hi - lo + 1, anchor, hull))
        if parts:
            rid, start, n, anchor, hull = map(np.concatenate, zip(*parts, strict=True))
            spans, k, weight = _combine(rid, start, n, anchor, hull, size)
            yield _rows(spans, rid[k], start[k], n[k], anchor[k], hull[k], weight, ["rid", "start", "n", "anchor", "hull", "weight"])


def _suffixes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The suffixes of the asked intervals: a token of the first bytes, and in ``rest`` 32 bits of the next token, the place and
    whether it stands for several. Rows with n are spans that repeat within the batch: ``rest`` is their start, t1 any value.
    """
    for batch in slices(batches):
        rids = batch.column("rid").to_numpy(zero_copy_only=False)
        texts, asked = as_bytes(batch.column("text").to_pylist()), batch.column("asked")
        starts = [np.array(x.values.field("start")) for x in asked]
        lengths = [np.array(x.values.field("n")) for x in asked]
        parts = []
        for a, b in chunks(texts):
            buf = Buffer(texts[a:b])
            per = [len(x) for x in starts[a:b]]
            owner = np.repeat(np.arange(b - a), per)
            lo = np.concatenate(starts[a:b]).astype(np.int64) + buf.ends[owner]
            n = np.concatenate(lengths[a:b]).astype(np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            who = np.repeat(owner, n)
            at, first = np.unique(at, return_index=True)
            who = who[first]
            cut = min(BLOCK, size)
            parts.append((rids[a + who], at - buf.ends[who], buf.ranges(at, at + cut), buf.ranges(at + cut, at + size)))
        if parts:
            rid, start, t1, t2 = map(np.concatenate, zip(*parts, strict=True))
            one = np.ones(len(rid), np.int64)
            spans, k, weight = _combine(rid, start, one, t1, t2, size)
            place = (start[k].astype(np.uint64) << np.uint64(1)) | (weight > 1).astype(np.uint64)
            rest = np.concatenate([spans[1].astype(np.uint64), (t2[k] >> np.uint64(32) << np.uint64(32)) | place])
            n = np.concatenate([spans[2] - spans[1], np.zeros(len(k), np.int64)])
            first = np.concatenate([mix(spans[0].view(np.uint64) ^ spans[1].view(np.uint64)), t1[k]])
            cols = [np.concatenate([spans[0], rid[k]]), n.astype(np.int32), first.view(np.int64), rest.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rid", "n", "t1", "rest"])


def multikey_quicksort(tokens: list[np.ndarray], small: int = 1024) -> np.ndarray:
    """The order that sorts rows by their tokens: three-way partition by one token at a time.

    Rows less or greater than the pivot are sorted on by the same token, equal rows by the next one, runs of up to ``small`` rows at once.
    """
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if depth == len(tokens) or b - a < 2:
            continue
        rows = order[a:b]
        key = tokens[depth][rows]
        if b - a <= small:
            order[a:b] = rows[np.lexsort([t[rows] for t in tokens[depth:]][::-1])]
            continue
        pivot = np.sort(key[:: max(1, len(key) // 9)])[len(key[:: max(1, len(key) // 9)]) // 2]
        less, same = key < pivot, key == pivot
        x, y = a + int(less.sum()), a + int(less.sum() + same.sum())
        order[a:b] = np.concatenate([rows[less], rows[same], rows[~(less | same)]])
        todo += [(a, x, depth), (x, y, depth + 1), (y, b, depth)]
    return order


def _heads(*tokens: np.ndarray) -> np.ndarray:
    """Marks the first row of each group of equal rows, from sorted tokens."""
    new = np.ones(len(tokens[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([t[1:] != t[:-1] for t in tokens])
    return new


def _columns(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> list[np.ndarray] | None:
    parts = list(batches)
    return [pa.chunked_array([b.column(c) for b in parts]).to_numpy() for c in names] if parts else None


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorts one range of runs: byte spans of those equal to a neighbour, and the runs that are to be unpacked (``open``)."""
    cols = _columns(batches, ("rid", "start", "n", "anchor", "hull", "weight"))
    if cols is None:
        return
    order = multikey_quicksort(cols[3:5])
    rid, start, n, anchor, hull, weight = (c[order] for c in cols)
    first_a, first_h = _heads(anchor), _heads(anchor, hull)
    of_a, of_h = np.cumsum(first_a) - 1, np.cumsum(first_h) - 1
    times = np.bincount(of_h, weight)
    again = (times[of_h] > 1) & (weight == 1)  # rows that stand for several have their spans already
    head = np.flatnonzero(first_h)
    in_a = of_a[head]
    total, alone = np.bincount(in_a, times), np.bincount(in_a, times == 1)
    unpack = (total > 1) & (alone > 0)
    unpack[[0, -1]] = True
    ask = head[unpack[in_a]]
    pick = np.concatenate([np.flatnonzero(again), ask])
    marks = np.arange(len(pick)) >= len(pick) - len(ask)
    length = np.where(marks, n[pick], n[pick] - 1 + size)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (marks, rid[pick], start[pick], length.astype(np.int32))], names=["open", "rid", "start", "n"])


_SPAN = np.dtype([("rid", "<i8"), ("start", "<i4"), ("n", "<i4")])
_EDGE = pa.struct([("t1", pa.int64()), ("t2", pa.int64()), ("alone", pa.bool_()), ("rid", pa.int64()), ("start", pa.int32())])
_BUCKET = "part int, spans binary, edge struct<t1:long,t2:long,alone:boolean,rid:long,start:int>"


def _bucket(batches: Iterator[pa.RecordBatch], size: int, parts_out: int) -> Iterator[pa.RecordBatch]:
    """Sorts one range of suffixes: the spans of those equal to a neighbour, packed by the part of their text, and its first and last suffix
    for the comparison across boundaries."""
    cols = _columns(batches, ("rid", "n", "t1", "rest"))
    if cols is None:
        return
    rid, n, t1, rest = cols
    done = n > 0
    found = [(rid[done], rest[done], rest[done] + n[done])]
    rid, t1, rest = rid[~done], t1[~done], rest[~done].view(np.uint64)
    t2 = rest >> np.uint64(32)
    order = multikey_quicksort([t1, t2])
    rid, t1, t2, place = rid[order], t1[order], t2[order].astype(np.int64), rest[order] & np.uint64(0xFFFFFFFF)
    new = _heads(t1, t2)
    same = np.append(~new, False)
    open_ = place & np.uint64(1) == 0
    start = (place >> np.uint64(1)).astype(np.int64)
    again = open_ & (same[1:] | same[:-1])
    found.append(_spans(rid[again], start[again], start[again] + size))
    a, b, c = map(np.concatenate, zip(*found, strict=True))
    rows = np.zeros(len(a), _SPAN)
    rows["rid"], rows["start"], rows["n"] = a, b, c - b
    part = (mix(a.view(np.uint64)) % np.uint64(parts_out)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    heads = np.flatnonzero(_heads(part))
    packed = [x.tobytes() for x in np.split(rows, heads[1:])] if len(heads) else []
    ends = sorted({0, int(np.flatnonzero(new)[-1])}) if len(rid) else []
    alone = open_ & ~again
    edges = [{"t1": int(t1[k]), "t2": int(t2[k]), "alone": bool(alone[k]), "rid": int(rid[k]), "start": int(start[k])} for k in ends]
    yield pa.RecordBatch.from_arrays(
        [pa.array([*part[heads].tolist(), *[0] * len(edges)], pa.int32()), pa.array(packed + [None] * len(edges), pa.binary()), pa.array([None] * len(packed) + edges, _EDGE)],
        names=["part", "spans", "edge"],
    )


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of some texts from all buckets, united."""
    packed = [raw for batch in batches for raw in batch.column("spans").to_pylist()]
    rows = np.frombuffer(b"".join(packed), _SPAN)
    a, b, c = _spans(rows["rid"], rows["start"].astype(np.int64), rows["start"].astype(np.int64) + rows["n"])
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b.astype(np.int32)), pa.array((c - b).astype(np.int32))], names=["rid", "start", "n"])


def repeated_spans(docs: DataFrame, size: int = 200) -> DataFrame:
    """Byte spans (rid, start, n), not yet united, of repeated passages. docs: rid, text."""
    n = partitions(docs.sparkSession)
    anchors = materialise(docs.select("rid", "text").mapInArrow(lambda it: _anchors(it, size), _ANCHORS), "anchors")
    ranged = anchors.where("weight > 0").repartitionByRange(n, "anchor", "hull", "rid")
    runs = materialise(ranged.mapInArrow(lambda it: _runs(it, size), "open boolean, rid long, start int, n int"), "runs")
    within = materialise(anchors.where("weight = 0").select("rid", "start", "n"), "batch-spans")
    drop(anchors)
    del anchors, ranged
    per_text = runs.where("open").groupBy("rid").agg(F.collect_set(F.struct("start", "n")).alias("asked"))
    suffixes = docs.select("rid", "text").join(per_text, "rid").mapInArrow(lambda it: _suffixes(it, size), _SUFFIXES)
    buckets = materialise(suffixes.repartitionByRange(n, "t1", "rest").mapInArrow(lambda it: _bucket(it, size, n), _BUCKET), "buckets")
    del per_text, suffixes
    packed = buckets.where("spans is not null").select("part", "spans")
    spans = materialise(packed.repartitionById(n, "part").mapInArrow(_unite, "rid long, start int, n int"), "window-spans")
    # The first and last suffixes of all buckets, two of each: those that equal one of another bucket.
    edges = buckets.where("edge is not null").select("edge.*")
    twice = edges.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    across = edges.where("alone").join(twice, ["t1", "t2"]).select("rid", "start", F.lit(size).alias("n"))
    free(docs.sparkSession)
    return within.unionByName(runs.where("not open").drop("open")).unionByName(spans).unionByName(across)


def numbered(docs: DataFrame) -> DataFrame:
    """docs (text, key: 128 bits) with ``rid``, 64 bits that tell all keys apart.

    It is half of the key, save for those few keys (n * n / 2**65 of n rows) that share that half with another one.
    """
    met = docs.groupBy("key.a").agg(F.min("key.b").alias("x"), F.max("key.b").alias("y")).where("x <> y")
    shared = [r[0] for r in met.select("a").collect()]
    other = F.xxhash64(F.lit(2), "key.b")
    return docs.withColumn("rid", F.when(F.col("key.a").isin(shared), other).otherwise(F.col("key.a")) if shared else F.col("key.a")).drop("key")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, spans = as_bytes(batch.column("text").to_pylist()), batch.column("spans")
        n_removed, n_spans, left = [], [], []
        for text, found in zip(texts, spans, strict=True):
            kept, at, removed, runs = [], 0, 0, 0
            if found.is_valid:
                start = np.array(found.values.field("start")).astype(np.int64)
                _, a, b = _spans(np.zeros(len(start), np.int64), start, start + np.array(found.values.field("n")))
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.append(text[at:x])
                    at, removed, runs = y, removed + y - x, runs + 1
            kept.append(text[at:])
            n_removed.append(removed)
            n_spans.append(runs)
            left.append(b"".join(kept))
        counts = [pa.array(c, pa.int64()) for c in ([len(t) for t in texts], n_removed, n_spans)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *counts, pa.array(left, pa.binary())], names=["row", "n_bytes", "n_removed", "n_spans", "kept"])


def _with_spans(docs: DataFrame, size: int, carry: tuple[str, ...]) -> DataFrame:
    docs = numbered(docs.select(F.struct(*carry).alias("row"), "text", row_key("doc_id", "text").alias("key")))
    spans = repeated_spans(docs, size).groupBy("rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(spans, "rid", "left").select("row", "text", "spans")


def remove_repeats(docs: DataFrame, size: int = 200, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (a struct of the carried columns), n_bytes, n_removed, n_spans and ``kept``: the bytes left of each document's UTF-8 text.

    A byte is removed if a passage of ``size`` bytes that covers it starts anywhere else too, in the
    same document included; passages never cross documents. Null texts are empty, texts shorter than ``size``
    stay whole. Rows with equal doc_id and text are documents of their own, so that both lose all
    repeated bytes. A null doc_id is kept. ``kept`` may break a UTF-8 character. A task holds one whole text at a time, with some tens of bytes for each of its bytes.
    """
    marked = _with_spans(docs, size, carry)
    return marked.mapInArrow(_cut, f"row {marked.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, size: int = 200) -> DataFrame:
    """docs with repeated passages cut from ``text`` and n_chars set anew; characters broken by a cut go. Documents of which nothing is left go."""
    carry = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    marked = _with_spans(docs, size, carry)

    def decode(batches):
        for batch in _cut(batches):
            kept, removed = batch.column("kept").to_pylist(), batch.column("n_removed").to_pylist()
            some = [k for k, (b, n) in enumerate(zip(kept, removed, strict=True)) if b or not n]
            texts = [kept[k].decode("utf-8", "ignore") for k in some]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(some, pa.int64())), pa.array(texts, pa.string())], names=["row", "text"])

    out = marked.mapInArrow(decode, f"row {marked.schema['row'].dataType.simpleString()}, text string")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    known = {c: F.col(f"row.`{c}`").alias(c) for c in carry}
    return out.select(*(known.get(c, F.col(c)) for c in docs.columns))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


