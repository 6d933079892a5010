"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per process.

A word's ids don't depend on the words around it once a text is cut where the tokenizer
itself always cuts: at white space where it drops that (``spaces="dropped"``), or
before a single space or line feed between two other characters where it keeps the space with the word after it
(``spaces="leading"``). Everything else is left to the library, as is each new word. Ids are
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Iterable
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of each of the two generations that a process keeps, and the longest word kept: some 320 MB at most, whatever the corpus.
#: Others are encoded again when they come up; ids don't depend on it.
KEPT_WORDS, KEPT_LENGTH = 700_000, 48
#: Words and their bytes that a process keeps where spaces lead, some 230 MB; beyond that it starts anew.
KEPT_LEADING, KEPT_BYTES = 1_000_000, 1 << 25
#: Words whose ids are gathered at once.
GATHERED = 1 << 18
#: All characters that Python takes for white space; the tokenizers' own lists are parts of it.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
_MARKS = ".,!?;:#$%&*|)]}"
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in _SPACES)
#: Of texts: a space or line feed beside other white space or at the end. Of words with what leads them: no white space at either end otherwise,
#: so that the tokenizer cuts before and behind them. Of words: a last letter or digit, one in all versions of Unicode, behind which it cuts marks off.
_ODD = rf"[{_SPACE}][ \n]|[ \n][{_SPACE}]|[ \n]\z"
_APART = rf"(?s)\A[ \n][^{_SPACE}](?:.*[^{_SPACE}])?\z"
_CORE = r"[0-9A-Za-zÀ-ÖØ-öø-ɏ]\z"
_encoders: dict[tuple, Encoder] = {}


def _gather(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of the words with these numbers; flat has all words' ids and size how many each has."""
    start, out = np.cumsum(size) - size, []
    for a in range(0, len(at), GATHERED):
        some = at[a : a + GATHERED]
        n = size[some]
        place = np.repeat(start[some] - (np.cumsum(n) - n), n)
        out.append(flat[place + np.arange(len(place))])
    return np.concatenate([flat[:0], *out])


def _per_text(flat: np.ndarray, size: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The ids of each text, of which offsets say where it begins among the numbers of words."""
    raw = _gather(flat, size, at).tobytes()
    ends = 4 * np.concatenate(([0], np.cumsum(size[at])))[offsets]
    return [raw[a:b] for a, b in pairwise(ends.tolist())]


class Encoder:
    def __init__(self, path: str, spaces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.spaces = spaces
        rule = self.library.normalizer
        self.folds = rule is not None and rule.normalize_str(string.ascii_letters) == string.ascii_letters.lower()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # Where spaces lead: numbers of words, their ids and how many each has, the words' bytes, and the bytes that each id stands for.
        self.numbers: dict[str, int] = {}
        self.flat, self.size, self.held = np.array([], "<u4"), np.array([], np.int64), 0
        self.width = np.zeros(max(self.library.get_vocab().values(), default=0) + 1, np.int64)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            self.width[k] = len(token)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of single words where spaces are dropped; the library says which word each id belongs to.

        It takes lists of words, or words of letters alone as one text, which is faster: each is one word to it too, and
        where it counts others, as some letters are changed to more, they are given as a list.
        """
        joined = [w for w in words if w.isalpha()]
        single = [w for w in words if not w.isalpha()] if joined else words
        out = {}
        for texts, some in ((True, joined), (False, single)):
            lists = [some[a : a + 256] for a in range(0, len(some), 256)]
            coded = self.library.encode_batch([" ".join(x) if texts else x for x in lists], is_pretokenized=not texts, add_special_tokens=False)
            for x, c in zip(lists, coded, strict=True):
                of = c.word_ids
                if texts and (not of or of[-1] + 1 != len(x)):
                    c = self.library.encode(x, is_pretokenized=True, add_special_tokens=False)
                    of = c.word_ids
                raw = np.array(c.ids, "<u4").tobytes()
                ends = 4 * np.searchsorted(np.array(of, np.int64), np.arange(len(x)), side="right")
                at = 0
                for w, end in zip(x, ends.tolist(), strict=True):
                    out[w] = raw[at:end]
                    at = end
        return out

    def _learn_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """As _learn, but the marks at a word's end, which always are tokens of their own, are cut off first, and where the library takes
        capital letters for small ones, so is done here: fewer words are new then."""
        plain, made = set(), []
        for w in words:
            core = w.rstrip(_MARKS)
            if not core or not core[-1].isalnum():
                core = w
            key = core.lower() if self.folds and core.isascii() else core
            plain.add(key)
            if key != w:
                made.append((w, key, w[len(core) :]))
        marks = {m for _, _, m in made}.difference(self.marks)
        self.marks.update(self._learn(list(marks)))
        kept = {w: c for w in plain if (c := self.known.get(w, self.older.get(w))) is not None}
        learnt = self._learn([w for w in plain if w not in kept])
        kept |= learnt
        learnt.update((w, kept[key] + self.marks[m]) for w, key, m in made)
        if len(self.marks) > KEPT_LENGTH * 1000:
            self.marks = {}
        return learnt

    def _keep(self, found: dict[str, bytes]) -> None:
        """Words in use are kept: a full generation becomes the older one, of which only words that come up again go on."""
        for w in [w for w in found if len(w) > KEPT_LENGTH]:
            del found[w]
        self.known.update(found)
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words."""
        ids = list(map(self.known.get, words))
        new = [w for w, x in zip(words, ids, strict=True) if x is None]
        learnt = {w: self.older[w] for w in new if w in self.older}
        learnt |= self._learn_words([w for w in new if w not in learnt])
        ids = [learnt[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        self._keep(learnt)
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes. Texts that hold the string of a special token are left to the library whole."""
        if self.spaces == "leading":
            return self.encode_column(pa.array(texts, pa.string()))
        out, at = [b""] * len(texts), []
        for k, text in enumerate(texts):
            low = text.lower()
            if any(x in low for x in self.special):
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                at.append(k)
        for k, ids in zip(at, self._encode([texts[k] for k in at]), strict=True):
            out[k] = ids
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for a in range(0, len(texts), 256):
            cut = [t.replace("\n", " ").split(" ") for t in texts[a : a + 256]]
            known = self.known
            found = [list(map(known.get, c)) for c in cut]
            new = {w for c, f in zip(cut, found, strict=True) if None in f for w, x in zip(c, f, strict=True) if x is None}
            learnt = {w: self.older[w] for w in new if w in self.older}
            learnt |= self._learn_words(new.difference(learnt))
            for k, f in enumerate(found):
                if None in f:
                    found[k] = [learnt[w] if x is None else x for w, x in zip(cut[k], f, strict=True)]
            out += [b"".join(f) for f in found]
            self._keep(learnt)
        return out

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """As encode, for a column of texts: Arrow cuts them and numbers their words, and ids are gathered by those numbers. Null is empty."""
        texts = pc.fill_null(texts, "")
        special = np.zeros(len(texts), bool)
        for x in self.special:
            special |= pc.match_substring(texts, x, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.spaces == "leading":
            return self._encode_leading(texts, special)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        words = self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, words), np.int64, len(words)) // 4
        out = _per_text(np.frombuffer(b"".join(words), "<u4"), size, coded.indices.to_numpy(), cut.offsets.to_numpy())
        for k in np.flatnonzero(special).tolist():
            out[k] = self.encode([texts[k].as_py()])[0]
        return out

    def _encode_leading(self, texts: pa.Array, special: np.ndarray) -> list[bytes]:
        """As encode_column, where spaces lead. Words begin with their space or line feed, but for the first of a text."""
        texts, out = texts.cast(pa.large_string()), [b""] * len(texts)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for mask in (~odd & ~special, odd & ~special):
            at = np.flatnonzero(mask)
            if not len(at):
                continue
            some = texts.take(pa.array(at))
            if odd[at[0]]:
                cut = pa.array([_BETWEEN.split(t) for t in some.to_pylist()], pa.large_list(pa.large_string()))
            else:
                cut = pc.split_pattern(pc.replace_substring(some, "\n", " \n"), " ")
            for k, ids in zip(at.tolist(), self._ids_of_cut(cut), strict=True):
                out[k] = ids
        for k in np.flatnonzero(special).tolist():
            out[k] = np.array(self.library.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _ids_of_cut(self, cut: pa.Array) -> list[bytes]:
        """The ids of each text, cut into words without their spaces but with their line feeds."""
        offsets, words = cut.offsets.to_numpy(), cut.flatten()
        coded, first = words.dictionary_encode(), words.take(pa.array(offsets[:-1])).dictionary_encode()
        lead = pc.if_else(pc.starts_with(coded.dictionary, "\n"), "", " ").cast(pa.large_string())
        forms = pa.concat_arrays([pc.binary_join_element_wise(lead, coded.dictionary, pa.scalar("", pa.large_string())), first.dictionary])
        at = coded.indices.to_numpy().astype(np.int64)
        at[offsets[:-1]] = len(coded.dictionary) + first.indices.to_numpy()
        used = np.bincount(at, minlength=len(forms)) > 0
        at, forms = (np.cumsum(used) - 1)[at], forms.filter(pa.array(used))
        # Marks at a word's end are always tokens of their own: fewer words are new without them.
        core = pc.utf8_rtrim(forms, _MARKS)
        core = pc.if_else(pc.match_substring_regex(core, _CORE), core, forms)
        marked = np.flatnonzero(pc.not_equal(pc.binary_length(core), pc.binary_length(forms)).to_numpy(zero_copy_only=False))
        marks = pc.extract_regex(forms.take(pa.array(marked)), f"(?P<marks>[{re.escape(_MARKS)}]+)\\z").field(0)
        parts = pa.concat_arrays([core, marks.cast(pa.large_string()), pa.array([""], pa.large_string())]).dictionary_encode()
        number = parts.indices.to_numpy()
        pairs = np.full((len(forms), 2), number[-1])
        pairs[:, 0] = number[: len(forms)]
        pairs[marked, 1] = number[len(forms) : -1]
        known = self._numbers_of(parts.dictionary)[pairs]
        out = _per_text(_gather(self.flat, self.size, known.ravel()), self.size[known].sum(axis=1), at, offsets)
        if len(self.numbers) > KEPT_LEADING or self.held > KEPT_BYTES:
            self.numbers, self.flat, self.size, self.held = {}, self.flat[:0].copy(), self.size[:0].copy(), 0
        return out

    def _numbers_of(self, words: pa.Array) -> np.ndarray:
        """The numbers of these distinct words, of which new ones are learnt."""
        names = words.to_numpy(zero_copy_only=False)
        at = np.fromiter(map(self.numbers.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            found = words.take(pa.array(new))
            apart = pc.match_substring_regex(found, _APART).to_numpy(zero_copy_only=False)
            new = np.concatenate([new[apart], new[~apart]])
            n = int(apart.sum())
            found = words.take(pa.array(new))
            at[new] = len(self.size) + np.arange(len(new))
            self.numbers.update(zip(names[new].tolist(), at[new].tolist(), strict=True))
            learnt = [self._learn_apart(found.slice(0, n)), self._learn_single(found.slice(n))]
            self.flat = np.concatenate([self.flat, *(ids for ids, _ in learnt)])
            self.size = np.concatenate([self.size, *(size for _, size in learnt)])
            self.held += pc.sum(pc.binary_length(found)).as_py()
        return at

    def _learn_apart(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that the tokenizer cuts off before and behind, and how many each has: the library takes many as one text, and the
        bytes that its ids stand for say where words end. If they don't fit the words', each is a text."""
        size = pc.binary_length(words).to_numpy()
        starts = np.append(np.arange(0, len(words), 256), len(words))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), words), pa.scalar("", pa.large_string())).to_pylist()
        ids = np.concatenate([np.array([], "<u4"), *(np.array(c.ids, "<u4") for c in self.library.encode_batch_fast(texts, add_special_tokens=False))])
        upto, ends = np.cumsum(self.width[ids]), np.cumsum(size)
        last = np.searchsorted(upto, ends)
        if len(words) and (upto[-1:].sum() != ends[-1] or not np.array_equal(upto[last], ends)):
            return self._learn_single(words)
        return ids, np.diff(last + 1, prepend=0)

    def _learn_single(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.array(c.ids, "<u4") for c in self.library.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.array([], "<u4"), *coded]), np.fromiter(map(len, coded), np.int64, len(coded))


def encoder(path: str, spaces: str) -> Encoder:
    """One encoder per process and file, so that worker reuse keeps its words."""
    if (path, spaces) not in _encoders:
        _encoders[path, spaces] = Encoder(path, spaces)
    return _encoders[path, spaces]


def forget() -> None:
    """Drops all encoders and their words."""
    _encoders.clear()
