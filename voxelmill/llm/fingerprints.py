"""Bottom-k fingerprints of documents (operator 2).

A fingerprint is the k least distinct 48-bit hashes of a text's word shingles, as base64 of their big-endian bytes in ascending order.
The least k hashes of a union follow from those of its parts, so fingerprints of parts merge into that of the whole,
and a likeness, a containment or a number of distinct shingles can be estimated from fingerprints alone.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import as_bytes, text_shingles, word_lists
from .scratch import partitions, slices, table

K, SHINGLE, BITS = 256, 5, 48


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k least distinct values, ascending."""
    if len(hashes) > 4 * k:
        some = np.unique(np.partition(hashes, 2 * k)[: 2 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def sketches(texts: list[bytes], k: int = K, size: int = SHINGLE) -> Iterator[np.ndarray]:
    for words in word_lists(texts):
        yield bottom(text_shingles(words, size) >> np.uint64(64 - BITS), k)


def encode(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
    return base64.b64encode(raw.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 8 - BITS // 8 :] = raw
    return wide.view(">u8").astype(np.uint64).ravel()


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the union's least k hashes that both have. Two empty sets are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**BITS / (float(a[-1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; an empty set is contained in any."""
    if not len(a):
        return 1.0
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, both / distinct_count(a, k))


def fingerprint_groups(prints: DataFrame, group: str, k: int = K) -> DataFrame:
    """Merges fingerprints (column fingerprint) into one per group.

    Equal hashes of a group are one row before and after the shuffle, ranked by their own, and the k least are gathered; a group's distinct hashes go through one
    task as sorted rows, not as a list. A null group is a group; null fingerprints are left out.
    """

    def unpack(batches):
        for batch in batches:
            hashes = [decode(t).astype(np.int64) for t in batch.column("fingerprint").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(hashes, pa.list_(pa.int64()))], names=["g", "hashes"])

    kind = prints.schema[group].dataType.simpleString()
    rows = prints.where("fingerprint is not null").select(F.col(group).alias("g"), "fingerprint")
    rows = rows.mapInArrow(unpack, f"g {kind}, hashes array<long>").select("g", F.explode("hashes").alias("h"))
    rank = F.dense_rank().over(Window.partitionBy("g").orderBy("h"))
    least = rows.distinct().withColumn("r", rank).where(F.col("r") <= k)
    gathered = least.groupBy("g").agg(F.sort_array(F.collect_list("h")).alias("hashes"))

    def repack(batches):
        for batch in batches:
            texts = [encode(np.array(h, np.uint64)) for h in batch.column("hashes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(texts)], names=[group, "fingerprint"])

    return gathered.mapInArrow(repack, f"`{group}` {kind}, fingerprint string")


#: Characters of a text that range bounds are told apart by, and rows sampled for each bound within one doc_id.
PREFIX, SAMPLED = 1000, 40


class Ranges:
    """Bounds that deal rows (doc_id, text) into ranges in descending doc_id order, then by text, null ids last.

    ``first[i]`` and ``last[i]`` are the ranges that start at doc_id ``ids[i]`` (ascending). An id of so many rows that they need several ranges has bounds within its
    texts, ``within``, each the start of a row's text; other ids start one range with all their rows.
    """

    def __init__(self, tops: list[int], within: dict[int | None, list[str]]):
        self.within, self.ids = within, np.array(tops, np.int64)
        sizes = [len(within.get(i, "-")) for i in reversed(tops)]
        ends = np.cumsum(sizes)
        self.first, self.last = (ends - sizes)[::-1].astype(np.int64), (ends - 1)[::-1].astype(np.int64)
        self.nulls = int(ends[-1]) if len(ends) else 0
        self.n = max(1, self.nulls + len(within.get(None, ())))

    def route(self, ids: np.ndarray, null: np.ndarray, key) -> tuple[np.ndarray, np.ndarray]:
        """The range of each row, and whether it is a range's first row (or one of several that bounds can't tell apart); ``key(k)`` is the start of row k's text."""
        if not len(self.ids):
            at, start = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        else:
            near = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            start = (self.ids[near] == ids) & ~null
            at = np.where(start, self.first[near], self.last[near])
            at[null] = self.n - 1
        for hot, bounds in self.within.items():
            base = self.nulls if hot is None else int(self.first[np.searchsorted(self.ids, hot)])
            for k in np.flatnonzero(null if hot is None else (ids == hot) & ~null).tolist():
                own = key(k)
                i = max(0, bisect_right(bounds, own) - 1)
                at[k], start[k] = base + i, bounds[i] == own
        return at, start


def _ranges(rows: DataFrame, n: int) -> Ranges:
    """About n ranges of about equal row counts. What reaches the driver are n ids and, for ids of more than a range's rows, some SAMPLED starts of texts a range."""
    size = rows.agg(F.count(F.lit(1)).alias("all"), F.count("doc_id").alias("known")).first()
    per_range, nulls = max(1, size.all // n), size.all - size.known
    k = max(1, -(-size.known // per_range))
    found = rows.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k + 1)], 20 * k).alias("p"), F.max("doc_id").alias("m")).first()
    held = Counter(found.p or [])
    tops = sorted({*held, found.m} - {None})
    hot: dict[int | None, int] = {i: c for i, c in held.items() if c > 1 and size.known > k}
    if nulls > per_range or (nulls and not tops):
        hot[None] = -(-nulls // per_range)
    within = {}
    for i, parts in hot.items():
        own = rows.where(F.col("doc_id").isNull() if i is None else F.col("doc_id") == i).select("start")
        size = own.agg(F.min("start").alias("least"), F.count(F.lit(1)).alias("n")).first()
        if not size.n:
            continue
        sample = sorted(r.start for r in own.sample(min(1.0, SAMPLED * parts / size.n), seed=7).collect())
        within[i] = sorted({size.least} | {sample[k * len(sample) // parts] for k in range(1, parts) if sample})
    return Ranges(tops, within)


def with_next(docs: DataFrame, work, schema: str) -> DataFrame:
    """Runs ``work`` over rows (doc_id, text) with the next text of each, in descending doc_id order over all documents.

    Each range of rows is one partition; the first row of a range goes to the range before it too, as its last row's next text. The next of the last row is the
    first. Nulls come last, equal ids by text. However many rows share an id, or have none, they are dealt over as many ranges as they need; only rows of one id whose
    texts are equal in their first PREFIX characters stay together.
    """
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    ranges = _ranges(rows.select("doc_id", F.substring("text", 1, PREFIX).alias("start")), partitions(docs.sparkSession))

    def route(batches):
        for batch in slices(batches):
            ids, texts = batch.column("doc_id"), batch.column("text")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            at, start = ranges.route(ids.fill_null(0).to_numpy(), null, lambda k, t=texts: t[k].as_py()[:PREFIX])
            extra = np.flatnonzero(start)
            taken = batch.take(pa.array(np.concatenate([np.arange(len(at)), extra])))
            to = np.concatenate([at, (at[extra] - 1) % ranges.n]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to), pa.array(np.arange(len(to)) >= len(at))], names=["doc_id", "text", "part", "lent"])

    def walk(batches):
        held, after = None, None  # the last row so far; the first lent row, which ends the range
        for batch in slices(batches):
            if after is not None:
                continue
            some = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lent")), strict=True))
            own = ([held] if held else []) + [r for r in some if not r[2]]
            after = next((r[1] for r in some if r[2]), None)
            if after is None and own:
                own, held = own[:-1], own[-1]
                if own:
                    yield from work([(i, t) for i, t, _ in own], held[1])
            elif own:
                yield from work([(i, t) for i, t, _ in own], after)

    routed = rows.mapInArrow(route, "doc_id long, text string, part int, lent boolean")
    placed = routed.repartitionById(ranges.n, "part")
    order = ["lent", F.col("doc_id").desc_nulls_last(), "text"]
    return placed.sortWithinPartitions(*order).mapInArrow(walk, schema)


def _compare(rows: list[tuple[int | None, str]], after: str) -> Iterator[pa.RecordBatch]:
    texts = [t for _, t in rows] + [after]
    edited = []
    for text, other in zip(texts[:-1], texts[1:], strict=True):
        n = len(text) // 3
        edited.append(text[: len(text) - n] + other[:n])
    raw = as_bytes(edited)
    own, new = list(sketches(as_bytes(texts))), list(sketches(raw))
    yield pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([i for i, _ in rows], pa.int64()),
            "n_chars": pa.array([len(t) for _, t in rows], pa.int64()),
            "edited_sha256": [hashlib.sha256(b).hexdigest() for b in raw],
            "fingerprint": [encode(s) for s in own[:-1]],
            "edited_fingerprint": [encode(s) for s in new],
            "near_edited": [resemblance(a, b) for a, b in zip(own[:-1], new, strict=True)],
            "near_next": [resemblance(a, b) for a, b in zip(own[:-1], own[1:], strict=True)],
            "n_distinct": [distinct_count(s) for s in own[:-1]],
            "contained_edited": [containment(a, b) for a, b in zip(own[:-1], new, strict=True)],
            "merged_fingerprint": [encode(merge(a, b)) for a, b in zip(own[:-1], new, strict=True)],
        }
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts.

    The edited text has its last third replaced by the start of the next document's text, in descending doc_id
    order. n_distinct estimates the text's distinct shingles, contained_edited the share of them that the edited text has, merged_fingerprint is that of
    both texts together. Null texts are empty; an empty text has an empty fingerprint; texts of fewer words than a shingle are one shingle.
    Rows with equal doc_ids follow each other by text; null doc_ids come last. One document alone is its own next.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, contained_edited double, merged_fingerprint string"
    return with_next(docs, _compare, schema)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
