"""Encoding and decoding with merge-type piece vocabularies (operator 13).

Merging always joins the two neighbours whose joint piece has the best score, the leftmost of equals. Its result is the one
sequence of pieces in which every two neighbours, merged again from their characters, come out as these two. So a
text is encoded without merging it: from each place the longest piece is tried first (an Aho-Corasick automaton finds
all pieces of many words in one pass), then its next shorter prefixes; a piece must be compatible with the one before it.
Where none is, the place is marked in a bitfield as failed and the piece before it gives way to a shorter one.

No piece goes on over the start of a space mark or a character that is no piece, so words between those are encoded one by one
and remembered by their process.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import slices, table

SPACE = "▁"
#: Words of each of two generations that a process keeps, the longest word kept, and neighbours whose compatibility is kept. What is dropped is worked out again.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 400_000, 48, 1_000_000
_WORDS = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
_coders: dict[str, Coder] = {}


class Vocabulary:
    """The pieces of a model file, their scores, and merging."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(pieces))]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        self.pieces = pieces
        self.cost = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        self.control = {i for i in range(len(pieces)) if model.is_control(i)}
        self.unknown = model.unk_id()
        probe = "  a\tb é\nﬁ "
        if model.normalize(probe) != SPACE + probe.replace(" ", SPACE) or len(self.bytes) != 256 or any(model.is_unused(i) for i in range(len(pieces))):
            raise ValueError("only models with byte pieces, a space put before the text and no other normalisation are supported")
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.ids):
            raise ValueError("a piece goes on over the start of a word")
        self.size = [len(p) for p in pieces]
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.edges: dict[int, tuple[list[str], list[str]]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merge(p) == [i]:  # else no merging ever ends with it
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def merge(self, text: str, edges: tuple[list[str], list[str]] | None = None) -> list[int]:
        """The pieces of a text of known characters, by merging; what its first and last part were on the way goes to ``edges``."""
        parts, n, cost = list(text), len(text), self.cost
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        open_ = [(cost[p], i, i + 1, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in cost]
        heapify(open_)
        while open_:
            _, i, j, p = heappop(open_)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != len(p):
                continue
            parts[i], parts[j] = p, ""
            after[i] = k = after[j]
            if edges is not None:
                if not i:
                    edges[0].append(p)
                if k == n:
                    edges[1].append(p)
            if k < n:
                before[k] = i
                if (q := p + parts[k]) in cost:
                    heappush(open_, (cost[q], i, k, q))
            if (h := before[i]) >= 0 and (q := parts[h] + p) in cost:
                heappush(open_, (cost[q], h, i, q))
        return [self.ids[p] for p in parts if p]

    def _edges(self, piece: int) -> tuple[list[str], list[str]]:
        if piece not in self.edges:
            text = self.pieces[piece]
            self.edges[piece] = [text[0]], [text[-1]]
            self.merge(text, self.edges[piece])
        return self.edges[piece]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two stay apart when their characters are merged again.

        The first merge over their border would join something that the left one ended with on its way to something the right one began with; where
        no such two make a piece there is nothing to merge.
        """
        pair = left, right
        if pair not in self.fits:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            cost, starts = self.cost, self._edges(right)[0]
            touch = any(a + b in cost for a in self._edges(left)[1] for b in starts)
            self.fits[pair] = not touch or self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return self.fits[pair]

    def prefix(self, piece: int) -> int:
        """The longest piece that is a shorter prefix of this one, or -1."""
        if piece not in self.shorter:
            text = self.pieces[piece]
            self.shorter[piece] = next((self.ids[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.automaton), -1)
        return self.shorter[piece]

    def longest(self, text: str) -> list[int]:
        """At each place of a text the longest piece that starts there, or -1."""
        out, size = [-1] * (len(text) + 1), self.size
        for end, piece in self.automaton.iter(text):
            out[end - size[piece]] = piece  # matches come by their ends, so the last one is the longest
        return out[-1:] + out[:-2]

    def backtrack(self, longest: list[int], at: int, end: int) -> list[int]:
        """The pieces of the characters [at, end), all known, with unknown ones around."""
        size, fits, failed, last = self.size, self.fits, None, -1
        start, found, piece = at, [], longest[at]
        while True:
            while piece >= 0:
                stop = at + size[piece]
                if (failed is None or not failed[stop - start >> 3] >> (stop - start & 7) & 1) and (last < 0 or (self.compatible(last, piece) if (ok := fits.get((last, piece))) is None else ok)):
                    break
                piece = self.prefix(piece)
            if piece >= 0:
                found.append(piece)
                if stop == end:
                    return found
                at, last, piece = stop, piece, longest[stop]
            else:
                if not found:
                    raise ValueError("no sequence of pieces fits")
                if failed is None:
                    failed = bytearray((end - start >> 3) + 1)
                failed[at - start >> 3] |= 1 << (at - start & 7)
                piece = found.pop()
                at -= size[piece]
                last = found[-1] if found else -1


class Coder:
    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.gap = next(c for c in map(chr, range(1, 0x110000)) if c not in v.ids and c not in "\n " and not c.isprintable())
        self.out = [b"" if i in v.control else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        self.out[v.unknown] = " ⁇ ".encode()
        self.raw = np.zeros(len(v.pieces), bool)
        for b, i in v.bytes.items():
            self.out[i] = bytes([b])
            self.raw[i] = True

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        out, v = {}, self.vocabulary
        for a in range(0, len(words), 512):
            some = words[a : a + 512]
            longest = v.longest(self.gap.join(some))
            at = 0
            for w in some:
                end, ids, run = at + len(w), [], at
                if -1 in longest[at:end]:
                    for k in range(at, end + 1):
                        if k == end or longest[k] < 0:
                            if k > run:
                                ids += v.backtrack(longest, run, k)
                            if k < end:
                                ids += [v.bytes[b] for b in w[k - at].encode()]
                            run = k + 1
                elif w:
                    ids = v.backtrack(longest, at, end)
                out[w] = np.array(ids, "<i4").tobytes()
                at = end + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian 32-bit."""
        out = []
        for a in range(0, len(texts), 256):
            cut = [_WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts[a : a + 256]]
            known = self.known
            coded = [list(map(known.get, c)) for c in cut]
            new = {w for c, f in zip(cut, coded, strict=True) if None in f for w, x in zip(c, f, strict=True) if x is None}
            learnt = {w: self.older[w] for w in new if w in self.older}
            learnt |= self._learn([w for w in new if w not in learnt])
            for c, f in zip(cut, coded, strict=True):
                out.append(b"".join([learnt[w] if x is None else x for w, x in zip(c, f, strict=True)] if None in f else f))
            known.update((w, x) for w, x in learnt.items() if len(w) <= KEPT_LENGTH)
            if len(known) > KEPT_WORDS:
                self.known, self.older = {}, known
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: bytes that are no UTF-8 become replacement characters one by one, one space before the first piece is dropped."""
        text, v, first = b"".join(map(self.out.__getitem__, ids)), self.vocabulary, 0
        while first < len(ids) and ids[first] in v.control:
            first += 1
        if first < len(ids) and not self.raw[ids[first]] and ids[first] != v.unknown and v.pieces[ids[first]].startswith(SPACE):
            text = text[1:]
        return text.decode("utf-8", "voxelmill_bytewise")


codecs.register_error("voxelmill_bytewise", lambda e: ("�", e.start + 1))


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array) of every whole text, as merging gives them, without begin or end ids.

    ``model`` is a merge-type model file at the same path on every machine. Null and empty texts have no ids; repeated rows give equal rows, an empty
    table gives an empty one; other columns are ignored. Characters that are no piece become the pieces of their bytes. The time for a very long word without
    spaces grows with its length, and a very long text is held by its task with its words and ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            coded = coder(model).encode([t or "" for t in batch.column("text").to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """Adds ``decoded``, the text of the ids; null ids have the text of none. A column of that name is replaced."""
    kept = [c for c in coded.columns if c != "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            decode_one = coder(model).decode
            texts = [decode_one(ids.values.to_numpy(False).tolist() if ids.is_valid else []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "decoded"])

    schema = coded.select(*kept).schema.add("decoded", "string")
    return coded.select(*kept).mapInArrow(decode, schema)


def op13_sentence_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode_pieces(encode_pieces(table(spark, sf_dir, "documents"), model), model)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
