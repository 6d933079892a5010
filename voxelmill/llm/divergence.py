"""Divergence of the sources of a language from each other and from the language as a whole (operator 12).

Texts are counted term by term within their tasks. The counts are then ranged by (lang, term): each range holds the sorted
array of the terms it keeps, a term's id is its place there, and as ids follow UTF-8 order, ties need no strings. Blocks of
such ranges become dense vectors of counts, one for each source of the language; sums over blocks give the divergences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, materialise, partitions, slices, table

SCALE = 10**9
#: Counts of terms that a task holds before it passes them on; bytes of a text that are cut into terms at once.
HELD, PIECE = 1 << 18, 1 << 19
#: Rows of a block of terms, and cells of a dense block of vectors.
BLOCK, CELLS = 1 << 16, 1 << 19
#: Parts of a group whose best terms are ranked apart before they are ranked together.
PARTS = 16

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTS = "lang string, source string, term string, n long, docs long"
_BLOCKS = "lang string, terms array<string>, sources array<string>, ids array<binary>, counts array<binary>, totals array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, runs of ASCII letters and of all other characters beyond ASCII, in lists of bounded size."""
    text = text.translate(_LETTERS)
    at = 0
    while len(text) - at > 2 * PIECE and (cut := text.find(b" ", at + PIECE)) >= 0:
        yield text[at:cut].split()
        at = cut
    yield (text[at:] if at else text).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (lang, source, term), summed within the task; the term '' stands for the group itself."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for batch in slices(batches):
        columns = [batch.column(c).to_pylist() for c in ("lang", "source")] + [batch.column("text").cast(pa.binary()).to_pylist()]
        for lang, source, text in zip(*columns, strict=True):
            n, docs = seen[lang, source]
            own: set[bytes] = set()
            for terms in term_lists(text):
                n.update(terms)
                own.update(terms)
            docs.update(own)
        if sum(1 + len(n) for n, _ in seen.values()) > HELD:
            yield from _rows(seen)
            seen.clear()
    yield from _rows(seen)


def _rows(seen: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (n, docs) in seen.items():
        terms = [b"", *n]
        size = len(terms)
        values = [pa.array([lang] * size), pa.array([source] * size), pa.array(terms, pa.binary()).cast(pa.string())]
        counts = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(docs.__getitem__, n)], pa.int64())]
        yield pa.RecordBatch.from_arrays(values + counts, names=["lang", "source", "term", "n", "docs"])


def _blocks(min_docs: int):
    """Blocks of kept terms from counts that come sorted by (lang, term): one row with the sorted terms and each source's ids and counts."""

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("lang", "term", "source", "n", "docs")), strict=True)

    def closed(lang, held):
        kept = np.array(sorted({t.encode() for t, _, _ in held if t}), object)
        at: dict[str, list] = {}
        for t, source, n in held:
            terms, counts = at.setdefault(source, ([], []))
            if t:
                terms.append(t.encode())
                counts.append(n)
        ids = {s: np.searchsorted(kept, np.array(t, object)).astype("<u4") if t else np.zeros(0, "<u4") for s, (t, _) in at.items()}
        values = [[lang], [[t.decode() for t in kept]], [list(at)], [[i.tobytes() for i in ids.values()]], [[np.array(c, "<i8").tobytes() for _, c in at.values()]], [[sum(c) for _, c in at.values()]]]
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64())]
        names = ["lang", "terms", "sources", "ids", "counts", "totals"]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    def block(batches):
        for lang, same in groupby(rows(batches), key=lambda r: r[0]):
            held, any_yet = [], False
            for term, own in groupby(same, key=lambda r: r[1]):
                own = list(own)
                if not term or sum(r[4] for r in own) >= min_docs:
                    held += [(term, r[2], r[3]) for r in own]
                if len(held) >= BLOCK:
                    yield closed(lang, held)
                    held = []
                    any_yet = True
            if held or not any_yet:
                yield closed(lang, held)

    return block


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / totals), exact: the quotient is divided out three decimal digits at a time."""
    left, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        q, left = np.divmod(left * 1000, totals)
        out = out * 1000 + q
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _compare(top: int):
    """Of each block, in dense slices: divergences of each source from each other one, summed, and the terms it has more often than its language."""

    def emit(lang, source, part, items, values):
        n = len(items)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lang, groups, terms = row["lang"], row["groups"], row["terms"]
                at = {g["source"]: k for k, g in enumerate(groups)}
                totals = np.array([g["total"] for g in groups], np.int64)
                sums = np.zeros((len(groups), len(groups)), np.int64)
                own = [(at[s], np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(c, "<i8")) for s, i, c in zip(row["sources"], row["ids"], row["counts"], strict=True)]
                width = max(1, CELLS // max(1, len(groups)))
                for lo in range(0, len(terms), width):
                    n = min(width, len(terms) - lo)
                    dense = np.zeros((len(groups), n), np.int64)
                    for k, ids, counts in own:
                        a, b = np.searchsorted(ids, [lo, lo + n])
                        dense[k] = np.bincount(ids[a:b] - lo, counts[a:b], n)
                    p = shares(dense, (totals + row["kept"])[:, None])
                    q = shares(dense.sum(0), totals.sum() + row["kept"])
                    for k in range(len(groups)):
                        sums[:, k] += divergences(p, p[k]).sum(1)
                    for k, group in enumerate(groups):
                        more = np.flatnonzero((dense[k] > 0) & (p[k] > q))
                        value = divergences(p[k][more], q[more])
                        best = np.lexsort((more, -value))[:top]
                        if len(best):
                            yield emit(lang, group["source"], "term", [terms[lo + t] for t in more[best]], value[best])
                for k, group in enumerate(groups):
                    others = [j for j in range(len(groups)) if j != k]
                    if others:
                        yield emit(lang, group["source"], "pair", [groups[j]["source"] for j in others], sums[k, others])

    return compare


def source_divergence(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from the others of its language (``pair``) and what it says more often (``term``).

    A language keeps the terms that at least ``min_docs`` of its documents have. Null text, lang and source are ''. Rows that repeat a doc_id are documents of
    their own; texts without terms still make a group; a language without kept terms has pairs of value 0; an empty table gives an empty one. Ties go by the
    UTF-8 bytes of the item. Very long texts are cut into terms piece by piece, and other columns are ignored. Each pair of sources is a row of the result,
    so a language's result grows with the square of its sources.
    """
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = docs.select(*columns).mapInArrow(_count, _COUNTS)
    counts = materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    spark = docs.sparkSession
    ranged = counts.repartitionByRange(partitions(spark), "lang", "term").sortWithinPartitions("lang", "term", "source")
    blocks = materialise(ranged.mapInArrow(_blocks(min_docs), _BLOCKS), "term-blocks")
    drop(counts)
    per_group = blocks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("g")).groupBy("lang", "g.sources").agg(F.sum("g.totals").alias("total"))
    per_lang = per_group.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(F.col("sources").alias("source"), "total"))).alias("groups"))
    per_lang = per_lang.join(blocks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept")), "lang")
    # Most blocks may be of one language: each language's totals go to as many places as there are partitions.
    salts = partitions(spark)
    per_lang = per_lang.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64("lang", "terms"), F.lit(salts)).cast("int"))
    found = materialise(salted.join(per_lang, ["lang", "salt"]).mapInArrow(_compare(top), _FOUND), "divergences")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # A block passes on its own best terms; of those of all blocks the best go on from parts of a group first, so that no task sees all blocks' rows.
    some = Window.partitionBy("lang", "source", "part", F.pmod(F.xxhash64("item"), F.lit(PARTS))).orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank")
    terms = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    return terms.unionByName(pairs.withColumn("rank", F.row_number().over(order)))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def op12_sql() -> str:
    return r"""
with d as (
  select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms
  from documents),
tf as (select lang, source, r, term, count(*) n from (select lang, source, r, unnest(terms) term from d) group by all),
kept as (select lang, term from tf group by all having count(*) >= 3),
size as (select lang, count(k.term) v from (select distinct lang from d) left join kept k using (lang) group by all),
g as (select distinct lang, source from d),
c as (select lang, source, term, sum(n) n from tf join kept using (lang, term) group by all),
total as (select lang, source, coalesce(sum(n), 0) total from g left join c using (lang, source) group by all),
own as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (t.total + s.v) p
  from g join kept k using (lang) left join c using (lang, source, term) join total t using (lang, source) join size s using (lang)),
whole as (
  select lang, term, 1 + 1000000000::hugeint * (sum(n) + 1) // (any_value(t.total) + any_value(s.v)) q
  from own join (select lang, sum(total) total from total group by all) t using (lang) join size s using (lang) group by lang, term),
pairs as (
  select a.lang, a.source, b.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join own x on x.lang = a.lang and x.source = a.source
  left join own y on y.lang = b.lang and y.source = b.source and y.term = x.term group by all),
terms as (select lang, source, term item, ((p - q) * (p - q) // q)::bigint as value from own join whole using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' part, item, value, row_number() over (partition by lang, source order by value desc, item)::int rank from pairs
union all
select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int rank from terms
qualify rank <= 200
"""
