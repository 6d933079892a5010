"""MinHash near-duplicates with b-bit signatures (operator 4).

1. Texts with equal shingle sets form a class; one row of each class goes on.
2. One permutation of the shingle hashes is cut into BINS bins; the least value of each is kept, empty bins borrow
   from others (optimal densification).  Some minima make a band key, as many bands as MISSED asks for, of as many minima as
   the bins allow then; the low BITS bits of all minima are packed as the signature.
3. Within each band bucket every member is paired with its least and its greatest member. Pairs whose estimated
   similarity is near the threshold or above are confirmed on full shingle sets, confirmed ones linked.
4. Buckets that still hold several components are compared in blocks: members of different components only. Signatures tell
   which members may have a partner; full sets decide. So no link that shares a bucket is lost, and of the links of a block
   only as many as join its components leave it.

A pair at the threshold misses all buckets with probability MISSED at most, a nearer one far more rarely; the estimate must
fall short by MARGIN, almost 5 standard errors, for a pair to be passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import as_bytes, mix, shingle_sets
from .scratch import materialise, partitions, row_key, slices, table

BINS, BITS, MISSED = 512, 4, 1e-7
MARGIN = 0.08
BLOCK = 1024
_U = np.uint64
_LANES = (np.arange(1, BINS + 1, dtype=np.uint64)) * _U(0x9E3779B97F4A7C15)


def minima(shingles: np.ndarray) -> np.ndarray:
    """BINS minima of a non-empty set of hashes."""
    h = mix(shingles ^ _U(0x5851F42D4C957F2D))
    out = np.full(BINS, ~_U(0))
    bins = (h >> _U(55)).astype(np.int64)
    order = np.argsort(h)  # the top bits are the bin, so each bin is a run
    first = np.ones(len(h), bool)
    first[1:] = bins[order[1:]] != bins[order[:-1]]
    out[bins[order[first]]] = h[order[first]]
    full = np.zeros(BINS, bool)
    full[bins] = True
    empty, attempt = np.flatnonzero(~full), 0
    while len(empty):
        attempt += 1
        source = (mix(_LANES[empty] ^ _U(attempt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) >> _U(55)).astype(np.int64)
        ok = full[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    return out


def bands(least: int) -> tuple[int, int]:
    """How many bands of how many minima: the longest ones (fewest chance meetings) that miss a pair at the threshold with probability MISSED at most."""
    fits = []
    for rows in range(1, 17):
        n = math.ceil(math.log(MISSED) / math.log(1 - (least / 100) ** rows)) if least < 100 else 1
        if n * rows <= BINS:
            fits.append((n, rows))
    return fits[-1]


def band_keys(m: np.ndarray, n: int, rows: int) -> np.ndarray:
    keys = m[: n * rows].reshape(n, rows) * _LANES[:rows]
    return mix(keys.sum(1) + _LANES[:n]).view(np.int64)


def pack(m: np.ndarray) -> bytes:
    """The low bits of the minima, two to a byte."""
    low = (mix(m) & _U(15)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures, row by row: the share of equal values, corrected for chance collisions."""
    d = x ^ y
    equal = ((d & 15) == 0).sum(1) + ((d & 240) == 0).sum(1)
    chance = 2.0**-BITS
    return (equal / BINS - chance) / (1 - chance)


def _sketch(batches: Iterator[pa.RecordBatch], size: int, shape: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, h1, h2, sig, keys = [], [], [], [], []
        for s in shingle_sets(as_bytes(batch.column("text").to_pylist()), size):
            n.append(len(s))
            h1.append(int(np.add.reduce(s, dtype=np.uint64).view(np.int64)))
            h2.append(int(np.add.reduce(mix(s), dtype=np.uint64).view(np.int64)))
            m = minima(s) if len(s) else None
            sig.append(None if m is None else pack(m))
            keys.append(None if m is None else band_keys(m, *shape))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["rid", "doc_id", "n", "h1", "h2", "sig", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = list(shingle_sets(as_bytes(batch.column("text").to_pylist()), size))
        full = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), full], names=["id", "members"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of their 0/1 rows over shared members."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    owner, column = owner[shared], rank[column[shared]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        lo, hi = np.searchsorted(column, [a, a + 8192])
        rows = np.zeros((len(sets), 8192), np.float32)
        rows[owner[lo:hi], column[lo:hi] - a] = 1
        out += rows @ rows.T
    return out


def _open_pairs(ids, comps, n, sides, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's rows that lie in different components and whose sizes allow a link."""
    i, j = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
    x, y = np.repeat(i, len(j)), np.tile(j, len(i))
    ok = (comps[x] != comps[y]) & ((ids[x] < ids[y]) | (sides[x] != 2))
    ok &= 100 * np.minimum(n[x], n[y]) >= least * np.maximum(n[x], n[y])
    return x[ok], y[ok]


def _candidates(cols: dict[str, list], least: int) -> list[int]:
    """Rows of a block that signatures don't keep from every open partner."""
    ids, comps, n, sides = (np.array(cols[c]) for c in ("id", "component", "n", "side"))
    sigs = np.frombuffer(b"".join(cols["sig"]), np.uint8).reshape(len(ids), -1)
    x, y = _open_pairs(ids, comps, n, sides, least)
    near = [estimate(sigs[x[k : k + 8192]], sigs[y[k : k + 8192]]) >= least / 100 - MARGIN for k in range(0, len(x), 8192)]
    near = np.concatenate(near) if near else np.zeros(0, bool)
    return np.unique(np.concatenate([x[near], y[near]])).tolist()


def _links(cols: dict[str, list], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block by full shingle sets: as many as join its components (a forest), not all."""
    ids, comps, n, sides = (np.array(cols[c]) for c in ("id", "component", "n", "side"))
    x, y = _open_pairs(ids, comps, n, sides, least)
    both = _common([np.array(m, np.int64) for m in cols["members"]])[x, y]
    ok = 100 * both >= least * (n[x] + n[y] - both)
    x, y = x[ok], y[ok]
    low, high = np.minimum(comps[x], comps[y]), np.maximum(comps[x], comps[y])
    _, first = np.unique(np.stack([low, high]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while c in root:
            c = root[c]
        return c

    chosen = []
    for k in first.tolist():
        c, d = find(int(low[k])), find(int(high[k]))
        if c != d:
            root[c] = d
            chosen.append(k)
    return ids[x[chosen]], ids[y[chosen]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """The rows of each block, from rows sorted by block."""
    held: dict[str, list] = {}
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        keys = np.array(cols["key"])
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and held["key"][-1] != cols["key"][a]:
                yield held
                held = {}
            for c, v in cols.items():
                held.setdefault(c, []).extend(v[a:b])
    if held:
        yield held


def _keep_candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for cols in _blocks(batches):
        rows = _candidates(cols, least)
        if rows:
            names = ("key", "id", "component", "n", "side")
            yield pa.RecordBatch.from_arrays([pa.array([cols[c][k] for k in rows], pa.int32() if c == "side" else pa.int64()) for c in names], names=names)


def _block_links(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for cols in _blocks(batches):
        a, b = _links(cols, least)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _confirm(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Pairs whose full shingle sets overlap enough: 100 * intersection >= least * union."""
    a = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - both
    return pairs.join(a, "a").join(b, "b").where(100 * both >= F.lit(least) * union).select("a", "b")


def _estimated(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs that neither their sizes nor their signatures exclude."""
    a = sigs.select(F.col("id").alias("a"), F.col("sig").alias("s"), F.col("n").alias("n1"))
    b = sigs.select(F.col("id").alias("b"), F.col("sig").alias("t"), F.col("n").alias("n2"))
    sized = pairs.join(a, "a").join(b, "b").where(100 * F.least("n1", "n2") >= F.lit(least) * F.greatest("n1", "n2"))

    def keep(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS // 2) for c in ("s", "t"))
            ok = pa.array(estimate(x, y) >= least / 100 - MARGIN)
            yield batch.select(["a", "b"]).filter(ok)

    return sized.select("a", "b", "s", "t").mapInArrow(keep, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, least: int = 85) -> DataFrame:
    """rid, doc_id, n_shingles, component_id and kept of every row of docs.

    Documents are linked if 100 * intersection >= least * union of their shingle sets; component_id is
    the smallest doc_id that a document reaches by links, kept tells whether that is its own. Null and empty texts
    have an empty set and are linked with nothing. Equal texts are linked. Rows that repeat a doc_id with one text
    are all kept if their id is the smallest; a null doc_id takes part in links but is never the smallest
    (alone, it has a null component and is kept). Extra columns are ignored.
    """
    return _components(docs, size, least).drop("group")


def _components(docs: DataFrame, size: int, least: int) -> DataFrame:
    """near_duplicates with ``group``, the same number for all rows that links join; null for rows without words."""
    docs = docs.select("doc_id", "text").withColumn("rid", row_key("doc_id", "text"))
    shape = bands(least)
    schema = "rid struct<a:long,b:long>, doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>"
    rows = materialise(docs.mapInArrow(lambda it: _sketch(it, size, shape), schema), "sketches")
    full = rows.where("n > 0")
    classes = full.groupBy("h1", "h2", "n").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_doc"))
    heads = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers, so no two classes meet by chance
    sketches = full.select("rid", "sig", "bands").join(heads.select("rid", "id", "n"), "rid").drop("rid").dropDuplicates(["id"])
    sketches = materialise(sketches, "class-sketches")
    banded = sketches.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    banded = materialise(banded.join(buckets, "key"), "buckets")
    asked = banded.select("id").distinct()
    sets = docs.select("rid", "text").join(heads.select("rid", "id").join(asked, "id"), "rid").select("id", "text").mapInArrow(lambda it: _sets(it, size), "id long, members array<long>")
    sets = materialise(sets.dropDuplicates(["id"]), "sets")
    stars = banded.select(F.explode(F.array("low", "high")).alias("a"), F.col("id").alias("b")).where("a <> b")
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(_confirm(_estimated(stars, sketches, least), sets, least), "star-links")
    labels = materialise(components(links), "labels")

    own = banded.select("key", "id").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = own.groupBy("key").agg(
        F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("m"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"),
    ).where("c1 < c2")
    per = per.groupBy("who", "m").agg(F.min("key").alias("key"))  # buckets of the same members are compared once
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = own.join(per, "key").withColumn("blocks", blocks)
    placed = placed.withColumn("i", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("i", "j"), F.greatest("i", "j")
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    placed = placed.select(F.xxhash64("key", low, high).alias("key"), "id", "component", side.alias("side"))
    placed = placed.join(sketches.select("id", "n", "sig"), "id")
    n = partitions(docs.sparkSession)
    dealt = lambda df: df.repartition(n, "key").sortWithinPartitions("key")
    near = dealt(placed).mapInArrow(lambda it: _keep_candidates(it, least), "key long, id long, component long, n long, side int")
    near = materialise(near, "near-members")
    more = dealt(near.join(sets, "id")).mapInArrow(lambda it: _block_links(it, least), "a long, b long")
    more = materialise(more.distinct(), "block-links")
    if not more.isEmpty():
        labels = materialise(components(links.unionByName(more)), "labels")
    grouped = heads.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least_doc = grouped.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = grouped.join(least_doc, "component").select("id", "component", "component_id")
    linked = full.select("rid", "doc_id", "h1", "h2", "n").join(heads.select("h1", "h2", "n", "id"), ["h1", "h2", "n"]).join(named, "id")
    linked = linked.select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("component").alias("group"))
    none = F.lit(None).cast("long").alias("group")
    alone = rows.where("n = 0").select("rid", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), none)
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """One row of each group of near duplicates, that of the least doc_id (null last), with all its columns.

    Rows without words stay; rows that repeat a doc_id and text are one document, of which one row stays.
    """
    found = _components(docs, size, least)
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid")).alias("m"))
    stays = first.select("m.rid").unionByName(found.where("group is null").select("rid").distinct())
    rows = docs.select(row_key("doc_id", "text").alias("rid"), F.struct(*docs.columns).alias("row"))
    return rows.join(stays, "rid", "left_semi").dropDuplicates(["rid"]).select("row.*")


def op4_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rid")


def op4_sql() -> str:
    """The same components in DuckDB's SQL, by counting the shingles that two documents share."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM u x JOIN u y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT root, b FROM r JOIN e ON a = r.doc_id),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)"""
