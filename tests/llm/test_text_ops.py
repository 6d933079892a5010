"""Fill-in-the-middle, source divergence and sentence pieces against brute force and SQL, on odd small tables."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import sentencepiece

import public_tokenizers
from pyspark.sql import functions as F
from voxelmill.llm import divergence, fill_middle, fingerprints, pieces, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, ids string, decoded string, cut string, h1 long, rank int"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    full = [(i, t, lang, source, 1, 2, "x", "y", "z", 3, 4) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def odd_rows(seed=3):
    rng = random.Random(seed)
    some = ["the", "The", "süß", "日本", "x1y", "a", "\n", "\n\n", " ", "  ", "\t", "<P>", "<S", "M>", "é", "😀", "\x00", "0", "-", "\r\n"]
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "\n", None, "a"), (3, "\n", None, "a"), (None, "no id\nhere", "de", None), (4, "one line", "de", "a"), (5, "x" * 30_000, "en", "a"), (6, "ab c\n" * 3000, "en", "b"), (7, "<M>", "en", "c")]
    return rows + [(10 + k, "".join(rng.choice(some) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "long source"])) for k in range(150)]


# 11 fill in the middle


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def filled(doc_id, text, units=lines, rate=100):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = units(text)
    low, high = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK_BYTES", 64)
    rows = odd_rows()
    docs = table(spark, rows)
    got = fill_middle.fill_in_middle(docs).withColumn("back", fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form"))).collect()
    assert collections.Counter(tuple(r)[:6] for r in got) == collections.Counter(filled(i, t) for i, t, _, _ in rows)
    assert collections.Counter(r.back for r in got) == collections.Counter(t or "" for _, t, _, _ in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0
    got = fill_middle.fill_in_middle(docs, "character", 40).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(filled(i, t, list, 40) for i, t, _, _ in rows)


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_cuts_of_chunks(monkeypatch, chunk):
    """Counts and places don't depend on the size of the chunks or slabs."""
    monkeypatch.setattr(fill_middle, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(fill_middle, "SLAB_CHUNKS", 5)
    rng = random.Random(chunk)
    texts = ["".join(rng.choice("ab \n\té日😀") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    words = lambda t: re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t)
    for unit, cut in (("line", lines), ("word", words), ("character", list)):
        c = fill_middle.Chunks(*fill_middle.text_buffer(fill_middle.pa.array([None, *texts, None])[1:-1]), unit)
        n = c.counts()
        assert n.tolist() == [len(cut(t)) for t in texts]
        ranks = np.array([rng.randint(0, k) for k in n])
        assert c.places(ranks).tolist() == [len("".join(cut(t)[:r])) for t, r in zip(texts, ranks, strict=True)]


def test_very_long_text(spark):
    text = "some line of words\n" * 150_000
    row = fill_middle.fill_in_middle(table(spark, [(1, text, "en", "a")])).collect()[0]
    assert tuple(row) == filled(1, text)


# 12 source divergence


def brute_divergence(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", [w.encode() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = collections.Counter(w for la, _, terms in docs if la == lang for w in set(terms))
        kept = {w for w, n in df.items() if n >= min_docs}
        counts = collections.defaultdict(collections.Counter)
        for la, source, terms in docs:
            if la == lang:
                counts[source].update(w for w in terms if w in kept)
        total = sum(counts.values(), collections.Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        q, p = share(total), {s: share(c) for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pair = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in counts if o != s]
            term = [(-f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pair), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(found), 1)]
    return sorted(out)


def divergence_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_divergence(spark, monkeypatch, small):
    if small:
        for name, value in (("HELD", 20), ("PIECE", 30), ("BLOCK", 5), ("CELLS", 9)):
            monkeypatch.setattr(divergence, name, value)
    rows = odd_rows() + [(900, "zz " * 4, "xx", "a"), (901, "zz", "xx", "b"), (902, "", "xx", "c"), (903, "only", "yy", "a")]
    want = brute_divergence(rows, 3, 4)
    assert divergence_rows(divergence.source_divergence(table(spark, rows), 3, 4)) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in want)
    assert divergence.source_divergence(table(spark, rows).limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    counts = [rng.randint(0, 10 ** rng.randint(1, 14)) for _ in range(2000)]
    totals = [c + rng.randint(1, 10 ** rng.randint(1, 14)) for c in counts]
    got = divergence.shares(np.array(counts), np.array(totals)).tolist()
    assert got == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals, strict=True)]


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_source_divergence"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    found = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(tuple, df.select(*found.columns).collect()), key=str) == sorted(found.fetchall(), key=str)


# 13 sentence pieces


def test_pieces(spark):
    rows = [*odd_rows(), (800, " ", "en", "a"), (801, "▁ ▁", "en", "a"), (802, "aaaa" * 500, "en", "a")]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.decode_pieces(pieces.encode_pieces(table(spark, rows), MODEL), MODEL).collect()
    want = collections.Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, _, _ in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert pieces.encode_pieces(table(spark, rows).limit(0), MODEL).count() == 0
    assert pieces.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).collect()[0].decoded == ""


def test_random_texts_and_ids_as_the_library(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_WORDS", 500)
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 300)
    library, c, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.Coder(MODEL), random.Random(5)
    some = ["a", "b", "e", "t", "h", "in", "the", " ", "   ", "\n", "\t", "1", "23", ".", "é", "日", "\x00", "�", "▁", "<s>", "<0x0A>", "😀", "ß", "　", "http", "://", "==", "----", "aaa", "ication", "\r"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + [" " * n + "the" for n in range(1, 60)]
    for t, ids in zip(texts, c.encode(texts), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(t), t
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(300), 259, 28705, 1, 0]) for _ in range(rng.randint(0, 6))]
        assert c.decode(ids) == library.decode(ids), ids


def test_backtracking_gives_way():
    """Where the longest piece can't stand, a shorter one is found, as by merging all."""
    v, rng, failed = pieces.Vocabulary(MODEL), random.Random(1), 0
    letters = [p for p in v.ids if p.isascii() and p.isalpha()]
    for _ in range(3000):
        text = "".join(rng.choice(letters)[: rng.randint(1, 9)] for _ in range(rng.randint(1, 5)))
        longest = v.longest(text)
        got = v.backtrack(longest, 0, len(text))
        assert got == v.merge(text)
        failed += got[0] != longest[0]
    assert failed > 50


# 2 fingerprints of rows that share an id


@pytest.mark.parametrize("hot", [None, 7])
def test_rows_of_one_id_are_dealt(spark, hot):
    rng = random.Random(8)
    rows = [(hot if rng.random() < 0.9 else k, f"{rng.random()} text {k}", "en", "a") for k in range(4000)]
    work = lambda some, after: iter([fill_middle.pa.RecordBatch.from_pydict({"id": fill_middle.pa.array([i for i, _ in some], fill_middle.pa.int64()), "text": [t for _, t in some], "next": [t for _, t in some[1:]] + [after]})])
    out = fingerprints.with_next(table(spark, rows), work, "id long, text string, next string").withColumn("part", F.spark_partition_id()).collect()
    order = sorted(((i, t) for i, t, _, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    following = dict(zip(order, [t for _, t in order[1:] + order[:1]], strict=True))
    assert len(out) == len(rows) and all(following[r.id, r.text] == r.next for r in out)
    sizes = collections.Counter(r.part for r in out)
    assert max(sizes.values()) <= 2 * len(rows) / len(sizes) and len(sizes) >= 4
