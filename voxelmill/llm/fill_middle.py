"""Fill-in-the-middle transformation (operator 11).

A text is cut where a unit (line, word or character) starts. Whether a byte starts a unit depends on it and the byte
before it only, so chunks that overlap by one byte count their unit starts independently of each other; prefix sums of
the counts give each document's number of units, name the chunk that owns each of its two cuts, and only those chunks
are looked at again for the place of the cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table

CHUNK_BYTES = 1 << 12
#: Chunks whose predicates are held at once: it bounds a task's memory, however long a text is.
SLAB_CHUNKS = 1 << 8
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Whether a unit starts at a byte, by the byte before it and the byte itself. Each text also starts one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "line": lambda before, at: before == 0x0A,
    "word": lambda before, at: _BLANK[before] & ~_BLANK[at],
    "character": lambda before, at: (at & 0xC0) != 0x80,
}


class Chunks:
    """Texts end to end, cut into chunks that never cross a text's end; unit starts and code points are counted by chunk."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str):
        self.data, self.ends, self.starts_unit = data, ends, UNITS[unit]
        lengths = np.diff(ends)
        per_text = -(-lengths // CHUNK_BYTES)
        self.first = np.concatenate([[0], np.cumsum(per_text)])
        owner = np.repeat(np.arange(len(lengths)), per_text)
        self.at = ends[owner] + (np.arange(len(owner)) - self.first[owner]) * CHUNK_BYTES
        self.to = np.minimum(self.at + CHUNK_BYTES, ends[owner + 1])
        self.heads = np.arange(len(owner)) == self.first[owner]
        units, points = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        for a in range(0, len(owner), SLAB_CHUNKS):
            b = min(a + SLAB_CHUNKS, len(owner))
            base = self.at[a]
            marks = self._marks(base, self.to[b - 1])
            marks[self.at[a:b][self.heads[a:b]] - base] = True
            units[a:b] = np.add.reduceat(marks, self.at[a:b] - base, dtype=np.int64)
            whole = (data[base : self.to[b - 1]] & 0xC0) != 0x80
            points[a:b] = np.add.reduceat(whole, self.at[a:b] - base, dtype=np.int64)
        self.units, self.points = (np.concatenate([[0], np.cumsum(x)]) for x in (units, points))

    def _marks(self, a: int, b: int) -> np.ndarray:
        """Unit starts among bytes [a, b), told by each byte and the one before it."""
        if a == 0:
            return np.concatenate([[True], self.starts_unit(self.data[: b - 1], self.data[1:b])])
        return self.starts_unit(self.data[a - 1 : b - 1], self.data[a:b])

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """For each text the code points before its unit of this rank (all of them if there is none)."""
        out = self.points[self.first[1:]] - self.points[self.first[:-1]]
        inside = np.flatnonzero(ranks < self.counts())
        wanted = self.units[self.first[inside]] + ranks[inside]
        owners = np.searchsorted(self.units, wanted, side="right") - 1
        for i, k, left in zip(inside.tolist(), owners.tolist(), (wanted - self.units[owners]).tolist(), strict=True):
            a, b = int(self.at[k]), int(self.to[k])
            marks = self._marks(a, b)
            if self.heads[k]:
                marks[0] = True
            cut = int(np.flatnonzero(marks)[left])
            out[i] = self.points[k] - self.points[self.first[i]] + np.count_nonzero((self.data[a : a + cut] & 0xC0) != 0x80)
        return out


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow column of texts and where each text ends, without a copy; null is empty."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(1, kind)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = int(ends[0]) if len(ends) else 0
    return data[first : int(ends[-1])], ends.astype(np.int64) - first


def cuts(text: Column, first: Column, second: Column, unit: str = "line") -> Column:
    """A struct of n, the units of a text, and the code points before the smaller and the larger of first % (n + 1) and second % (n + 1) units."""

    def places(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        chunks = Chunks(*text_buffer(texts), unit)
        n = chunks.counts()
        ranks = np.stack([np.asarray(x, np.int64) % (n + 1) for x in (one.to_numpy(False), two.to_numpy(False))])
        low, high = (chunks.places(r) for r in (ranks.min(0), ranks.max(0)))
        return pa.StructArray.from_arrays([pa.array(n), pa.array(low), pa.array(high)], ["n", "low", "high"])

    return F.arrow_udf(places, "n long, low long, high long")(text, first, second)


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = 100, spm_rate: int = 50, seed: str = "7") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every whole text, cut into prefix, middle and suffix at two unit starts.

    The four draws are digits of the SHA-256 of the seed and the doc_id, so a text's cut doesn't depend on other rows or on the order.
    ``rate`` per cent of the texts are transformed, ``spm_rate`` per cent of those to suffix-prefix-middle; the others, empty texts and texts
    that hold a mark themselves stay plain, with null prefix_chars and middle_chars. Null texts are empty, a null doc_id draws as no digits,
    repeated rows give equal rows, an empty table gives an empty one; other columns are ignored. A very long text is counted in slabs
    of a megabyte and needs no more memory than itself and its output.
    """
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    text = F.coalesce("text", F.lit("")).alias("text")
    out = docs.select("doc_id", text, *draws).withColumn("cut", cuts(F.col("text"), F.col("h1"), F.col("h2"), unit))
    held = [F.contains("text", F.lit(m)) for m in MARKS.values()]
    plain = (F.col("text") == "") | held[0] | held[1] | held[2] | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    low, high = F.col("cut.low"), F.col("cut.high")
    out = out.select("doc_id", F.col("cut.n").alias("n"), "text", form.alias("form"), low.alias("low"), high.alias("high"))
    part = {
        "prefix": F.expr("substring(text, 1, int(low))"),
        "middle": F.expr("substring(text, int(low) + 1, int(high - low))"),
        "suffix": F.expr("substring(text, int(high) + 1)"),
    }
    laid = {f: F.concat(*[x for p in order for x in (F.lit(MARKS[p]), part[p])]) for f, order in (("psm", ("prefix", "suffix", "middle")), ("spm", ("suffix", "prefix", "middle")))}
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", laid["psm"]).otherwise(laid["spm"])
    changed = F.col("form") != "plain"
    return out.select("doc_id", "n", "form", F.when(changed, F.col("low")).alias("prefix_chars"), F.when(changed, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The original text of an output; a transformed one holds each mark once."""
    parts = F.split(output, "|".join(MARKS.values()))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op11_sql() -> str:
    return r"""
with texts as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h from documents),
units as (select *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') u from texts),
draws as (
  select *, len(u)::bigint n, ('0x' || substr(h, 1, 8))::bigint h1, ('0x' || substr(h, 9, 8))::bigint h2,
    ('0x' || substr(h, 17, 8))::bigint h3, ('0x' || substr(h, 25, 8))::bigint h4
  from units),
parts as (
  select *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') p, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') s,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') m,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end form
  from draws)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
  sha256(t) restored_sha256
from parts
"""
