"""Ids of a column of texts against the library's own, and how many words the library is given."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from voxelmill.llm import tokens
from voxelmill.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "  ", "a", "Hello, World!!", "I'LL can't DON'T", "\tx y　z\r\n", "<|endoftext|>", "x <|EndOfText|> y", "İstanbul Kelvin ſ",
    "H̱ ẖ É é", "ﬁ ǅ ΣΑΣ ß 漢字 ªº ʰ", "a.b,c...d ...", "12 3a4 ½ ²", "     Z\n\nz", "\U00010400\U00010428 ก็", "\x00 \x1f",
]


def test_ids_of_a_column_are_the_librarys():
    found = Encoder(PATH, "dropped")
    texts = [*ODD, *ODD, " ".join(t or "" for t in ODD if "<" not in (t or ""))]
    want = [np.array(found.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert found.encode_column(pa.array(texts)) == want
    assert found.encode_column(pa.array(texts).slice(3)) == want[3:]
    assert found.encode_column(pa.array([], pa.string())) == []


def test_forms_of_a_word_are_learnt_once():
    found, given = Encoder(PATH, "dropped"), []

    class Counting:
        def __init__(self, library):
            self.library = library

        def __getattr__(self, name):
            return getattr(self.library, name)

        def encode_batch(self, texts, **options):
            given.extend(w for t in texts for w in (t.split() if isinstance(t, str) else t))
            return self.library.encode_batch(texts, **options)

    found.library = Counting(found.library)
    found.encode(["The the THE the, The. tHe"])
    assert [w for w in given if w.isalpha()] == ["the"]


BYTES = public_tokenizers.path("byte_bpe_50k.json")
LEADING = [
    *ODD, " ", "\n", "a\n", " a", "\na b", "a.\nB c", "a!\nB, c.", "a \nb", "a\n b", "a\n\nb c", "a  b c", "c d  ", "c d\n ", "a  b", "a \x1c b", "a\x85b c", "x\u180e y",
    "a\n.b !c", "it's. 'S 's.", "é! ×! ÷. ɏ? ʰ. 漢. 5% ½.", "a.\x00 b", "x\t\ty z.\nw", "é. ö!", "a 　b", "z" * 500 + " y", "<|endoftext|>. a\nb", "a! " * 700,
]


def test_ids_of_a_column_are_the_librarys_where_spaces_lead(monkeypatch):
    found, rng = Encoder(BYTES, "leading"), np.random.default_rng(5)
    some = np.array([" ", " ", "\n", "a", "B", "é", ".", "!", "'s", "7", "\t", "　", "ab", "\U0001f600"])
    texts = [*LEADING, *LEADING, *("".join(rng.choice(some, 12)) for _ in range(3000))]
    want = [np.array(found.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert found.encode_column(pa.array(texts)) == want
    assert found.encode_column(pa.array(texts).slice(3)) == want[3:]
    assert found.encode_column(pa.array([], pa.string())) == []
    monkeypatch.setattr(tokens, "KEPT_LEADING", 20)
    assert [x for a in range(0, len(texts), 40) for x in found.encode_column(pa.array(texts[a : a + 40]))] == want and len(found.numbers) <= 20
    found.width += 1  # a vocabulary whose tokens don't stand for the bytes of the text
    assert found.encode_column(pa.array(texts)) == want


def test_words_at_line_ends_are_learnt_once():
    found, given = Encoder(BYTES, "leading"), []

    class Counting:
        def __init__(self, library):
            self.library = library

        def __getattr__(self, name):
            def call(texts, *args, **options):
                given.extend(texts)
                return getattr(self.library, name)(texts, *args, **options)

            return call

    found.library = Counting(found.library)
    found.encode(["one two.\nThree four", "one two\nThree, four!"])
    given.clear()
    found.encode(["one two!\nThree. four,\nThree two four", "one four.\nThree five"])
    assert [t.strip() for t in given] == ["five"]
