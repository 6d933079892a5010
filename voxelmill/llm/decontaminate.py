"""Benchmark decontamination by template windows (operator 6).

A text becomes a sequence of canonical tokens: numbers, names (capitalised words inside a sentence) and units after a number turn
into typed placeholders, other words into lower case. Windows of WINDOW tokens are hashed and joined with those of the
benchmark: with all placeholders, with those of numbers only, as names depend on letter case, and with none, so that verbatim
copies full of numbers and copies in other letter case are found too. For each document and item the matched windows give pairs of slot values; a slot is
consistent if one value of the item always stands for one value of the document. Each occurrence of an item in a document is
judged by itself, and so is the document as a whole: it is contaminated by an item if any of these has enough of the item's
windows with consistent slots, so re-parameterised copies are caught, also beside other variants of the same template.

An item needs a share of its windows, so every document that it contaminates has one of its rarest ones, taken until fewer than that share are left:
only those make candidates, and windows that many items share multiply nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import CHUNK_BYTES, Buffer, as_bytes, chunks, mix, shingles
from .scratch import materialise, row_key, slices, table

WINDOW, LEAST_TOKENS = 8, 4
#: Forms of windows: with all placeholders, with those of numbers and units, without any, and the letters of a short item as they stand.
FULL, NUMBERS, WORDS, LETTERS = range(4)
#: Share of an item's windows that a document must have, and share of consistent slots.
COVER, CONSISTENT = 0.5, 0.8
#: Bits of the filter of benchmark windows: a fixed size; beyond it more windows reach the join, none is lost.
FILTER_BITS = 1 << 23

# Abbreviations of units.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs day days week weeks month months year years usd eur dollars euros percent kmh mph kw kwh w v a hz khz mhz ghz kb mb gb tb °c °f %".split())

_UNIT_HASHES = np.sort(np.concatenate([Buffer([u.encode()]).ranges(np.array([0]), np.array([len(u.encode())]), True) for u in sorted(UNITS)]))
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1B873593CC9E2D51, 0x38B34AE5A1E38B93, 0x52DCE729E6546B64))
_DASHES, _QUOTES = re.compile(rb"\xe2\x80[\x90-\xbf]"), re.compile(rb"\xe2\x80[\x98-\x9f\xa2]")
#: A capital after one of these may only open a sentence.
_OPENING = np.isin(np.arange(256), np.frombuffer(b".!?\n:;\"([{*", np.uint8))


def _lower(text: bytes) -> bytes:
    """The text in lower case, of the same length in bytes: letters that would change theirs stay."""
    if text.isascii():
        return text.lower()
    plain = text.decode("utf-8", "surrogatepass")
    low = plain.lower().encode("utf-8", "surrogatepass")
    if len(low) == len(text):
        return low
    pairs = ((c.encode("utf-8", "surrogatepass"), c.lower().encode("utf-8", "surrogatepass")) for c in plain)
    return b"".join(x if len(x) == len(c) else c for c, x in pairs)


class Tokens:
    """Canonical tokens of some texts, all at once.

    A token is a run of letters and digits, with the points and commas inside numbers; bytes above 127 count as letters, save for
    typographic dashes and quotes. ``forms`` has hashes and marks of placeholders, FULL, with those of numbers and units only, and
    with none: a hash is that of a token's lower case or of its placeholder.
    A name starts with a capital, goes on in small letters and doesn't follow a line or sentence end, a colon, quote, bracket or list mark.
    """

    def __init__(self, texts: list[bytes]):
        texts = [_DASHES.sub(b" ", _QUOTES.sub(b'"', t)) if b"\xe2\x80" in t else t for t in texts]
        self.buf = buf = Buffer(texts)
        self.low = low = Buffer([_lower(t) for t in texts])
        b = buf.bytes
        if not len(b):
            self.start = self.end = self.at = np.zeros(0, np.int64)
            self.forms = [(np.zeros(0, np.uint64), np.zeros(0, bool))] * 3
            self.at = np.zeros(len(texts) + 1, np.int64)
            return
        digit = (b >= 48) & (b <= 57)
        upper = (b >= 65) & (b <= 90)
        solid = digit | upper | ((b >= 97) & (b <= 122)) | (b >= 128)
        inside = np.zeros(len(b), bool)
        inside[1:-1] = ((b[1:-1] == 46) | (b[1:-1] == 44)) & digit[:-2] & digit[2:]
        inside[buf.ends[1:-1][buf.ends[1:-1] < len(b)]] = False
        solid |= inside
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        heads, tails = buf.ends[:-1], buf.ends[1:] - 1
        heads, tails = heads[heads < len(b)], tails[tails >= 0]
        first[heads] |= solid[heads]
        last[tails] |= solid[tails]
        self.start, self.end = start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(start, buf.ends)
        word = low.ranges(start, end)
        stops = np.concatenate([[0], np.cumsum(_OPENING[b])])
        opens = np.ones(len(start), bool)
        opens[1:] = stops[start[1:]] > stops[end[:-1]]
        opens[self.at[:-1][self.at[:-1] < len(start)]] = True
        number = digit[start]
        capital = upper[start].copy()
        accented = np.flatnonzero((b[start] == 0xC3) & (end - start > 2))
        capital[accented] = (b[start[accented] + 1] >= 0x80) & (b[start[accented] + 1] <= 0x9E)
        capitals = np.concatenate([[0], np.cumsum(upper)])
        name = capital & ~opens & (end - start > 1) & (capitals[end] - capitals[start] <= 1)
        after = np.flatnonzero(number[:-1] & ~opens[1:]) + 1
        unit = np.zeros(len(start), bool)
        unit[after] = np.isin(word[after], _UNIT_HASHES)
        typed = np.where(number, _NUMBER, np.where(unit, _UNIT, word))
        self.forms = [(np.where(name & ~unit & ~number, _NAME, typed), number | name | unit), (typed, number | unit), (word, np.zeros(len(start), bool))]

    def windows(self, size: int, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first token and hash of all windows of one size in a form, with literal words in half their places: others say nothing.

        Windows that a fuller form has alike are left out. LETTERS are the bytes from the first to the last token of fewer than LEAST_TOKENS; one
        token alone must be all that its text has.
        """
        if form == LETTERS:
            at = np.arange(max(0, len(self.start) - size + 1))
            text = np.searchsorted(self.at, at, side="right") - 1
            at = at[(at + size <= self.at[text + 1]) & ((size > 1) | (np.diff(self.at)[text] == 1))]
            h = self.low.ranges(self.start[at], self.end[at + size - 1])
            return np.searchsorted(self.at, at, side="right") - 1, at, mix(h ^ np.uint64(size + 1000))
        kind, slot = self.forms[form]
        h = shingles(kind, size)
        if not len(h):
            return self.at[:0], self.at[:0], h
        count = lambda marks: (c := np.concatenate([[0], np.cumsum(marks)]))[size:] - c[:-size]
        text = np.searchsorted(self.at, np.arange(len(h)), side="right") - 1
        keep = (np.arange(len(h)) + size <= self.at[text + 1]) & (2 * count(slot) <= size)
        for fuller, marks in self.forms[:form]:
            keep &= (count(kind != fuller) > 0) | (2 * count(marks) > size)
        keep = np.flatnonzero(keep)
        return text[keep], keep, mix(h[keep] ^ np.uint64(size))

    def slots(self, at: int, size: int, form: int) -> list[str]:
        """What stands in the placeholders of a window."""
        if form == LETTERS:
            return []
        k = at + np.flatnonzero(self.forms[form][1][at : at + size])
        return [self.buf.bytes[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(self.start[k], self.end[k], strict=True)]


def forms_of(size: int) -> tuple[int, ...]:
    return (FULL, NUMBERS, WORDS) if size >= LEAST_TOKENS else (LETTERS,)


_ITEM = "item_id long, iid long, window long, at int, slots array<string>, worded boolean, of_worded int, of int, size int, width int"


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, iid (item and text), window (hash), at, slots, worded (whether half of it are words), of_worded and of (windows of the item, such and all), size, width (see _occurrences).

    Items shorter than a window are one window of their own length, with fewer than LEAST_TOKENS tokens by their letters.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, iids, out = batch.column("item_id").to_pylist(), batch.column("iid").to_pylist(), []
            for k, text in enumerate(as_bytes(batch.column("text").to_pylist())):
                tokens = Tokens([text])
                size = min(WINDOW, len(tokens.start))
                if not size:
                    continue
                forms = forms_of(size)
                own = set(tokens.windows(size, forms[0])[1].tolist())
                of, width = len(tokens.start) - size + 1, max(2, len(tokens.start) // 2)
                for form in forms:
                    _, at, h = tokens.windows(size, form)
                    out += [(ids[k], iids[k], int(x), int(p), tokens.slots(int(p), size, form), int(p) in own, len(own), of, size, width) for p, x in zip(at, h.view(np.int64), strict=True)]
            cols = zip(*out, strict=True) if out else [()] * 10
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.bool_(), *[pa.int32()] * 4)
            names = ["item_id", "iid", "window", "at", "slots", "worded", "of_worded", "of", "size", "width"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("iid")).mapInArrow(cut, _ITEM)


def _rare(items: DataFrame, cover: float) -> DataFrame:
    """iid and window of the rarest windows of each item: fewer than ``cover`` of its windows, and of its worded ones, are left without."""
    often = items.groupBy("window").agg(F.count_distinct("iid").alias("f"))
    places = items.join(often, "window").groupBy("iid", "at", "worded", "of", "of_worded").agg(F.max("f").alias("f"))
    rank = lambda *by: F.row_number().over(Window.partitionBy("iid", *by).orderBy("f", "at"))
    enough = lambda r, n: F.col(r) <= F.col(n) - F.ceil(cover * F.col(n)) + 1
    places = places.withColumn("r", rank()).withColumn("rw", rank("worded"))
    places = places.where(enough("r", "of") | (F.col("worded") & enough("rw", "of_worded"))).select("iid", "at")
    return items.select("iid", "at", "window").join(places, ["iid", "at"]).select("iid", "window").distinct()


def _filter(windows: DataFrame) -> np.ndarray:
    """A bit for each hash slot that a benchmark window falls into; slots are folded by Spark and only FILTER_BITS / 8 bytes come back."""
    words = windows.select(F.pmod("window", F.lit(FILTER_BITS)).alias("s")).distinct()
    words = words.groupBy((F.col("s") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("s") % 32).cast("int"))).alias("bits"))
    out = np.zeros(FILTER_BITS // 32, np.int32)
    for r in words.toLocalIterator():
        out[r.w] = r.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _occurrences() -> Column:
    """The occurrences that a hit may belong to: its place less its place in the item, in cells of half an item's length.

    Cells of two grids overlap by half, so an occurrence whose insertions shift it by no more than half a cell is whole in one of them; the next one
    is further away. 0, 0 is the document as a whole, for which a window that the document repeats says nothing new.
    """
    shift = F.col("pos") - F.col("at")
    cell = lambda grid, by: F.struct(F.lit(grid).alias("grid"), F.floor((shift + by) / F.col("width")).alias("cell"))
    whole = F.struct(F.lit(0).alias("grid"), F.lit(0).cast("long").alias("cell"))
    places = F.array(cell(1, F.lit(0)), cell(2, F.floor(F.col("width") / 2)))
    return F.when(F.col("first"), F.array_append(places, whole)).otherwise(places)


def _parts(text: bytes, size: int) -> Iterator[tuple[bytes, int, int]]:
    """A text in parts of about CHUNK_BYTES with, in each, the range of bytes in which its own windows start.

    Parts begin a stretch earlier, so that tokens look alike, and end so late that no window of ``size`` tokens is cut.
    """

    def edge(at: int) -> int:
        """The next place between two characters."""
        at = min(max(at, 0), len(text))
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return at

    def tokens(a: int, b: int) -> int:
        return len(Tokens([text[a:b]]).start)

    a = 0
    while a < len(text):
        space = re.compile(rb"\s").search(text, a + CHUNK_BYTES)
        b = space.start() if space else len(text)
        back = reach = 512
        while edge(a - back) > 0 and tokens(edge(a - back), a) < 3:
            back *= 2
        while edge(b + reach) < len(text) and tokens(b, edge(b + reach)) <= size:
            reach *= 2
        start = edge(a - back)
        yield text[start : edge(b + reach)], a - start, b - start
        a = b


def _hits(texts: list[bytes], sizes: list[int], bits: np.ndarray) -> Iterator[tuple]:
    """Text number, window, form, slots, place and whether it is the first such one of its text, of all windows in the filter."""
    mask = np.uint64(FILTER_BITS - 1)

    def find(tokens: Tokens, number, lo: int, hi: int, base: int, done: set):
        for size in sizes:
            for form in forms_of(size):
                text, at, h = tokens.windows(size, form)
                hit = np.flatnonzero(bits[(h & mask).astype(np.int64)])
                for k, p, x in zip(text[hit].tolist(), at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True):
                    if lo <= tokens.start[p] < hi:
                        slots = tokens.slots(p, size, form)
                        seen = (number + k, x, *slots)
                        yield number + k, x, form, slots, base + p - int(tokens.at[k]), seen not in done
                        done.add(seen)

    for a, b in chunks(texts):
        if len(texts[a]) <= 2 * CHUNK_BYTES:
            yield from find(Tokens(texts[a:b]), a, 0, 1 << 62, 0, set())
            continue
        base, done = 0, set()
        for part, lo, hi in _parts(texts[a], max(sizes, default=1)):
            tokens = Tokens([part])
            skip, upto = np.searchsorted(tokens.start, [lo, hi])
            yield from find(tokens, a, lo, hi, base - int(skip), done)
            base += int(upto - skip)


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, consistent: float = CONSISTENT) -> DataFrame:
    """rid, doc_id, item_id, n_windows, of, cover and consistency of every contaminated document and item.

    n_windows of the item's ``of`` windows occur in the document, or in its best occurrence where only that is consistent: of the windows with words in half their
    places where that share is larger, else of all. Items of fewer than LEAST_TOKENS tokens match
    by their letters and the marks between them, those of one token only a text that is that token. Null and empty texts and items match nothing; items with equal ids are
    compared each, and the best is reported. Rows that repeat a doc_id and text give one result; a null doc_id is reported as null. Very long texts are read in
    overlapping parts. Extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").withColumn("rid", row_key("doc_id", "text"))
    items = materialise(benchmark_windows(benchmark).dropDuplicates(["iid", "window", "at"]), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # WINDOW different ones at most
    seen = spark.sparkContext.broadcast(_filter(items))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = list(_hits(as_bytes(batch.column("text").to_pylist()), sizes, seen.value))
            at, *cols = zip(*out, strict=True) if out else [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.bool_())
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("rid", "doc_id")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["rid", "doc_id", "window", "form", "found", "pos", "first"])

    hits = docs.mapInArrow(cut, "rid struct<a:long,b:long>, doc_id long, window long, form int, found array<string>, pos long, first boolean")
    hits = materialise(hits, "hits")
    likely = hits.select("rid", "window").distinct().join(_rare(items, cover), "window").select("rid", "iid").distinct()
    both = hits.join(likely.join(items, "iid"), ["rid", "window"]).where(F.size("slots") == F.size("found"))
    key = ["rid", "doc_id", "item_id", "iid", "place"]
    # A place that matches in several forms votes once, by the fullest of them.
    fixed = ["worded", "of_worded", "of", "width"]
    both = both.groupBy(*key[:4], "at", "pos").agg(F.min(F.struct("form", "first", "slots", "found", *fixed)).alias("h")).select(*key[:4], "at", "pos", "h.*")
    both = both.withColumn("place", F.explode(_occurrences()))
    # Windows of words in half their places or more speak for the item; all of them do where they cover more of it.
    covered = both.groupBy(*key).agg(F.count_distinct(F.when(F.col("worded"), F.col("at"))).alias("w"), F.max("of_worded").alias("of_w"), F.count_distinct("at").alias("n"), F.max("of").alias("of_n"))
    words = (F.col("w") * F.col("of_n") >= F.col("n") * F.col("of_w")) & (F.col("of_w") > 0)
    covered = covered.select(*key, F.when(words, F.col("w")).otherwise(F.col("n")).alias("n_windows"), F.when(words, F.col("of_w")).otherwise(F.col("of_n")).alias("of"))
    covered = covered.where(F.col("n_windows") >= cover * F.col("of"))
    pairs = both.select(*key, F.explode(F.arrays_zip("slots", "found")).alias("p")).select(*key, "p.slots", "p.found")
    votes = pairs.groupBy(*key, "slots", "found").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.groupBy(*key, "slots").agg(F.max("n").alias("best"), F.sum("n").alias("all"))
    slots = votes.groupBy("rid", "iid", "place").agg((F.sum("best") / F.sum("all")).alias("consistency"))
    out = covered.join(slots, ["rid", "iid", "place"], "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    out = out.where(F.col("consistency") >= consistent).withColumn("cover", F.col("n_windows") / F.col("of"))
    out = out.groupBy(*key[:3]).agg(F.max(F.struct("cover", "n_windows", "consistency", "of")).alias("m"))
    return out.select(*key[:3], "m.n_windows", "m.of", "m.cover", "m.consistency")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns."""
    bad = contaminated(docs, benchmark).select("rid").distinct()
    kept = docs.select(F.struct(*docs.columns).alias("row"), row_key("doc_id", "text").alias("rid")).join(bad, "rid", "left_anti")
    return kept.select("row.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("rid")
