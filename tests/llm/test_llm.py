"""The training-data operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import datetime
import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from voxelmill.llm import decontaminate, fingerprints, hashing, licences, near_dedup, packing, quality, queries, sharding, suffix_dedup, token_files, tokens, warc
from voxelmill.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, score double"


def table(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 0.5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(4)
    base = prose(rng, 300)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (3, 90, 200)]
    rows = [(1, None), (2, ""), (3, base), (4, base), (4, base), (6, near[0]), (7, near[1]), (8, near[2]), (9, "two words"), (10, "Two  WORDS"), (11, "\n\t "), (12, "x" * 20_000)]
    return rows + [(20 + k, prose(rng, 120)) for k in range(6)] + [(40, prose(rng, 9000)), (None, "one more text without an id")]


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text, size):
    w = words_of(text)
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


# Hashing and components


def test_shingle_sets_count_words():
    texts = ["", "a", "a b c d", "A B c D", "é  é\té", "x " * 5000]
    got = list(hashing.shingle_sets(hashing.as_bytes(texts), 3))
    assert [len(s) for s in got] == [len(shingle_set(t, 3)) for t in texts]
    assert np.array_equal(got[2], got[3])


def test_components(spark):
    links = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100}


# 1 licences


def test_licences_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(licences.scan_sql()).fetchall()
    got = [tuple(r) for r in queries.QUERIES["op1_licence_scan"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and got


def test_licences_of_odd_texts(spark):
    mit = dict(enumerate(t for n, t in licences.TEMPLATES if n == "MIT"))
    rows = [(1, None), (2, ""), (3, "Licensed under CC BY-NC 4.0."), (4, "text\n" + mit[2] + "\nmore"), (5, "LICENSED  under the apache license version 2.0\n" * 2), (6, "no licence here at all"), (3, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.licence): (r.n_units, r.dice) for r in licences.licence_scan(table(spark, rows)).collect()}
    assert set(got) == {(3, "CC-BY-NC-4.0"), (4, "MIT"), (5, "Apache-2.0")} and got[4, "MIT"][1] == 1.0
    assert licences.licence_scan(table(spark, rows).limit(0)).count() == 0


def test_licences_inside_longer_texts(spark):
    apache = [t for n, t in licences.TEMPLATES if n == "Apache-2.0"]
    w = (apache[1] + " # " + apache[2]).split()
    header = "\n#\n".join("# " + " ".join(w[k : k + 5]) for k in range(0, len(w), 5))
    rows = [(1, "This package is free to use. Released under the MIT License. See the manual."), (2, header), (3, "We say that this work is\nlicensed under the GNU General Public License,\nversion 2. Ask us for more\nof it"), (4, "see the license of the software in the manual " * 9)]
    got = {(r.doc_id, r.licence): (r.n_units, r.dice) for r in licences.licence_scan(table(spark, rows)).collect()}
    assert got == {(1, "MIT"): (1, 1.0), (2, "Apache-2.0"): (2, 1.0), (3, "GPL-2.0"): (1, 1.0)}


def test_licences_in_running_words_match_sql(spark, monkeypatch):
    monkeypatch.setattr(licences, "BLOCK", 64)
    rng, texts = random.Random(6), [t for _, t in licences.TEMPLATES]
    rows = [(1, None), (2, ""), (3, "x"), (3, "mit license")]
    for k in range(120):
        w = prose(rng, rng.randint(0, 90)).split()
        for t in rng.sample(texts, rng.randint(1, 3)):
            t = t.split()
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(["the", "other", ""])
            at = rng.randint(0, len(w))
            w[at:at] = t[rng.choice([0, 0, 0, 1]) :]
        rows.append((10 + k // 2, rng.choice([" ", " ", "\n", "\n# "]).join(w)))
    rows += [(500, " ".join([texts[0], prose(rng, 40)] * 300)), rows[9]]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = con.sql(licences.scan_sql()).fetchall()
    got = [tuple(r) for r in licences.licence_scan(table(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 40


# 2 fingerprints


def test_fingerprints(spark, odd):
    rows = sorted(odd, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = collections.defaultdict(list)
    for r in fingerprints.fingerprint_documents(table(spark, odd)).collect():
        got[r.doc_id].append(r)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert sum(map(len, got.values())) == len(rows)
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(x for x in got[doc_id] if x.edited_sha256 == sha)
        assert r.n_chars == len(text)
        a = shingle_set(text, 5)
        assert abs(r.near_edited - like(a, shingle_set(edited, 5))) < 0.15
        assert abs(r.near_next - like(a, shingle_set(after, 5))) < 0.15
        e = shingle_set(edited, 5)
        assert abs(r.n_distinct - len(a)) <= 0.25 * len(a)
        assert abs(r.contained_edited - (len(a & e) / len(a) if a else 1)) < 0.2
        both = sorted({*fingerprints.decode(r.fingerprint).tolist(), *fingerprints.decode(r.edited_fingerprint).tolist()})[: fingerprints.K]
        assert fingerprints.decode(r.merged_fingerprint).tolist() == both
    assert fingerprints.fingerprint_documents(table(spark, [])).count() == 0


def test_fingerprints_merge(spark):
    rng = random.Random(9)
    texts = [prose(rng, 400) for _ in range(4)]
    parts = [next(fingerprints.sketches([t.encode()])) for t in texts]
    whole = set().union(*(shingle_set(t, 5) for t in texts))
    merged = parts[0]
    for p in parts[1:]:
        merged = fingerprints.merge(merged, p)
    assert abs(fingerprints.distinct_count(merged) - len(whole)) < 0.3 * len(whole)
    assert fingerprints.containment(parts[0], merged) > 0.7
    assert np.array_equal(fingerprints.decode(fingerprints.encode(merged)), merged)
    df = spark.createDataFrame([("g", fingerprints.encode(p)) for p in parts] + [(None, fingerprints.encode(parts[0])), ("h", None)], "g string, fingerprint string")
    got = {r.g: r.fingerprint for r in fingerprints.fingerprint_groups(df, "g").collect()}
    assert got == {"g": fingerprints.encode(merged), None: fingerprints.encode(parts[0])}


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(2)
    texts = [b"", prose(rng, 900).encode(), b"x" * 3000, b"a b", prose(rng, 3000).encode(), " ".join("é" * 40 for _ in range(90)).encode()]
    read = lambda: [[w.tolist() for w in hashing.word_lists(texts)], [s.tolist() for s in hashing.shingle_sets(texts, 5)], [s.tolist() for s in fingerprints.sketches(texts)]]
    whole = read()
    monkeypatch.setattr(hashing, "CHUNK_BYTES", 700)
    assert read() == whole and len(hashing.pieces(texts)[0]) > 20


# 3 packing and 8 token files


def test_tokens_match_the_library():
    texts = ["", " ", "a  b\n c\t d ", "don't  stop now \x1c ok", "  lead", "tail  ", "x\n\n y", "é ̈a", "1234 56  ΑΣ Σ", "<|endoftext|> hi", "a <|EndOfText|> b <|startoftext|>c", "a  b", "\nfoo bar\n", "z" * 500]
    for name, spaces in (("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        e = tokens.Encoder(public_tokenizers.path(name), spaces)
        assert e.encode(texts) == want and e.encode(texts) == want


def ids_of(name, texts, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes() for t in texts]


def test_plan_uses_all_pieces():
    rng = random.Random(2)
    for _ in range(20):
        counts = collections.Counter(rng.randint(1, 40) for _ in range(60))
        fills = packing.plan(dict(counts), 50)
        used = collections.Counter()
        for f, times in fills:
            assert sum(f) <= 50
            for x in f:
                used[x] += times
        assert used == counts and sum(t for _, t in fills) <= packing.lower_bound(counts, 50) + 1
    assert packing.plan({}) == [] and packing.plan({10: 7}, 30) == [((10, 10, 10), 2), ((10,), 1)]


def test_all_fillings_of_few_lengths():
    rng = random.Random(9)
    for _ in range(60):
        counts = {x: rng.randint(1, 3) for x in rng.sample(range(2, 30), rng.randint(1, 5))}
        room = rng.randint(5, 50)
        want = set()
        for ns in itertools.product(*(range(n + 1) for n in counts.values())):
            left = room - sum(x * n for x, n in zip(counts, ns, strict=True))
            if left >= 0 and not any(x <= left and n < counts[x] for x, n in zip(counts, ns, strict=True)):
                want.add(tuple(sorted((x for x, n in zip(counts, ns, strict=True) for _ in range(n)), reverse=True)))
        assert {tuple(f) for f in packing._all(sorted(counts), counts, room)} == want
        out = packing.fillings(sorted(counts), counts, room, 1000)
        assert set(out) <= want and sum(out[0]) == max(map(sum, want))
        assert all(any(packing._dominates(o, f) for o in out) for f in want)


def least_bins(pieces, room):
    """The fewest sequences, by trying all."""
    best = len(pieces)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(pieces):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] >= pieces[k] and bins[b] not in bins[:b]:
                put(k + 1, [*bins[:b], bins[b] - pieces[k], *bins[b + 1 :]])
        put(k + 1, [*bins, room - pieces[k]])

    put(0, [])
    return best


def test_plan_needs_no_more_than_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        pieces = sorted((rng.randint(3, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        assert sum(t for _, t in packing.plan(dict(collections.Counter(pieces)), 24)) == least_bins(pieces, 24)


def test_plan_of_many_short_pieces():
    rng = random.Random(5)
    mixed = collections.Counter(min(4095, int(rng.lognormvariate(5, 1.3)) + 1) for _ in range(5000)) + collections.Counter({1: 30_000, 6: 30_000})
    for counts in ({1: 100_000}, {5: 100_000}, {10: 100_000}, mixed):
        fills = packing.plan(dict(counts))
        used = collections.Counter()
        for f, times in fills:
            assert sum(f) <= packing.ROOM
            for x in f:
                used[x] += times
        assert used == counts and sum(t for _, t in fills) <= packing.lower_bound(dict(counts), packing.ROOM) + 1


def test_packing(spark, odd):
    got = packing.pack_documents(table(spark, odd)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.ROOM
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // packing.ROOM) + 1
    want = collections.Counter()
    for (doc_id, _), ids in zip(odd, ids_of("word_bpe_49k.json", [t for _, t in odd], 1), strict=True):
        for k, a in enumerate(range(0, len(ids), 4 * packing.ROOM)):
            want[doc_id, k, k * packing.ROOM, zlib.crc32(ids[a : a + 4 * packing.ROOM])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in got) == want
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_token_files(spark, odd, tmp_path):
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    manifest = token_files.write_token_files(table(spark, odd), f"file://{tmp_path}", public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    coded, start = ids_of("byte_bpe_50k.json", [t for _, t in rows], 0), 0
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    for r, ids in zip(got, coded, strict=True):
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids) // 4, ids)
        start += len(ids) // 4


def test_token_file_frames(tmp_path):
    path = str(tmp_path / "one.zst")
    fs, local = token_files.filesystem(path)
    with fs.open_output_stream(local, compression=None) as out:
        w = token_files.Writer(out)
        for k in range(40):
            w.add(k if k else None, np.full(20_000, k, "<u4").tobytes())
        w.close()
    with fs.open_input_file(local) as f:
        r = token_files.Reader(f)
        assert len(r.table) > 3 and r.null[0] and [p for p, _ in r.documents([7, 3])] == [3, 7]
        assert dict(r.documents([7]))[7] == np.full(20_000, 7, "<u4").tobytes()
    raw = bytearray(open(path, "rb").read())
    raw[len(raw) // 8] ^= 255
    open(path, "wb").write(raw)
    with fs.open_input_file(local) as f, pytest.raises(Exception):
        list(token_files.Reader(f).documents())


# 4 near duplicates


def linked(rows, size, least):
    sets = [shingle_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= least * (len(a) + len(b) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    ids = collections.defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        ids[find(k)].append(doc_id)
    first = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return collections.Counter((i, len(sets[k]), first[find(k)], i == first[find(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(spark, odd, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(8)
    base = prose(rng, 80).split()
    family = []
    for k in range(25):
        w = list(base)
        for at in rng.sample(range(80), rng.randint(0, 4)):
            w[at] = f"edit{k}x{at}"
        family.append((500 + k, " ".join(w)))
    rows = odd + family
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == linked(rows, 3, 85)


def test_one_of_each_group_stays(spark):
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(3)]
    near = [t.replace(t.split()[9], "changed", 1) + " " for t in base]
    rows = [(None, base[0]), (None, near[0]), (7, base[1]), (7, near[1]), (7, near[1]), (9, base[2]), (None, near[2]), (4, ""), (4, ""), (5, None), (None, None)]
    docs = table(spark, rows)
    out = near_dedup.keep_one(docs)
    got = collections.Counter((r.doc_id, (r.text or "").strip()[:9]) for r in out.collect())
    assert out.columns == docs.columns and sum(got.values()) == 6
    assert {k: n for k, n in got.items() if k[0] in (4, 5, 7, 9)} == {(4, ""): 1, (5, ""): 1, (7, base[1][:9]): 1, (9, base[2][:9]): 1}


def test_no_documents_no_duplicates(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    assert near_dedup.near_duplicates(table(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_estimates_are_close():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    b = np.concatenate([a[:1000], rng.integers(0, 1 << 63, 150, dtype=np.uint64)])
    sig = [np.frombuffer(near_dedup.pack(near_dedup.minima(x)), np.uint8)[None] for x in (a, b)]
    assert abs(near_dedup.estimate(*sig)[0] - 1000 / 1350) < 0.1


# 5 quality


def test_quality(spark):
    out = queries.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = out.join(labels, "doc_id").collect()
    aside = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.predicted == r.quality for r in aside) >= 0.97 * len(aside) > 30
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    loss = -np.mean([math.log(max(1e-9, r.score if r.quality else 1 - r.score)) for r in aside])
    assert loss < 0.15


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (20, 1, 0), (12, 0, 0), (2, None, 0), (None, 0, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, odd)
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score_documents(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


# 6 decontamination


def test_decontamination(spark):
    item = "Alice met Bob near 12 old mills, and then they walked 30 km to Paris in 5 hours while it was raining on the hills."
    other = "Every planet of the outer ring turns slowly around its dim and distant star for ages."
    items = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (5, "a b")], "item_id long, text string")
    changed = item.replace("12", "7").replace("30 km", "45 m").replace("Bob", "Zoe")
    mixed = "Every planet of the outer ring but then all at once something quite different was said about it."
    rows = [(1, "Before. " + item + " After."), (2, changed), (3, None), (4, ""), (5, "nothing of the kind " * 40), (6, mixed), (7, other), (7, other), (None, other), (8, "x" * 5000)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 1), (7, 2), (None, 2)}
    left = decontaminate.without_contaminated(table(spark, rows), items)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 8] and left.columns == table(spark, rows).columns
    assert decontaminate.contaminated(table(spark, rows), items.limit(0)).count() == 0
    assert decontaminate.contaminated(table(spark, []), items).count() == 0


def test_inconsistent_slots(spark):
    item = "When Ann has 3 pears and gives 3 pears to each of her 3 friends then how many pears are there in all of it"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    uneven = item.replace("3 pears and", "4 pears and").replace("her 3", "her 8")
    got = decontaminate.contaminated(spark.createDataFrame([(1, item), (2, uneven)], "doc_id long, text string"), items)
    assert {r.doc_id for r in got.collect()} == {1}


def test_copy_beside_other_variants(spark):
    item = "Ann has 3 red pears and gives 12 green plums to old Bob who then eats 5 of them in the garden near 40 large trees"
    changed = [item.replace("3", f"{k}1").replace("12", f"{k}2").replace("5", f"{k}3").replace("40", f"{k}4").replace("Bob", n) for k, n in ((6, "Zoe"), (7, "Max"), (8, "Eve"))]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, ". ".join([*changed[:2], item, changed[2]])), (2, " ".join(["some words before it"] * 9 + [item, *changed])), (3, "nothing of the kind " * 40)]
    got = decontaminate.contaminated(table(spark, rows), items).collect()
    assert {r.doc_id for r in got} == {1, 2} and len(got) == 2
    assert [r.doc_id for r in decontaminate.without_contaminated(table(spark, rows), items).collect()] == [3]


def test_copies_full_of_numbers_or_in_other_case(spark):
    sums = "12 + 30 = 42, 15 + 27 = 42 and 9 * 7 = 63"
    names = "Yesterday the young Émile met Anna Berg and Karl Stein near Old Paris Bridge with Uncle Tom Grey, then Rosa Luna sang for Max Born"
    items = spark.createDataFrame([(1, sums), (2, names)], "item_id long, text string")
    rows = [(1, "See: " + sums + "."), (2, sums.replace("1", "8").replace("2", "5")), (3, names.lower()), (4, "so " + names.upper()), (5, names), (6, names.title()), (7, "nothing of the kind " * 40)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), items).collect()}
    assert got == {(1, 1), (3, 2), (4, 2), (5, 2), (6, 2)}


def test_short_and_slot_heavy_items(spark):
    texts = ["In 2019 Paris had 12 km, 30 kg, 5 hours, 7 days, 9 mph, 44 usd.", "2 + 3", "What is 17 times 23?", "yes", "Solve for x"]
    items = spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")
    rows = [(k, f"Some words before. {t} And some after it") for k, t in enumerate(texts, 1)]
    rows += [(6, "So: What is 17 times 23?"), (7, "He asked (What is 18 times 25?) and left"), (8, "yes"), (9, "2, 3 and 2 3"), (10, "SOLVE  FOR x"), (11, "now solve for x")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (5, 5), (6, 3), (7, 3), (8, 4), (11, 5)}


UNITS = set(decontaminate.UNITS)


def canonical(text):
    """The tokens of a text in three forms, each with its placeholders, and where they stand; by characters, not arrays."""
    text = re.sub("[\u2018-\u201f\u2022]", '"', text)
    text = re.sub("[\u2010-\u203f]", " ", text)
    out, after = [], 0
    for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f]|(?<=[0-9])[.,](?=[0-9]))+", text):
        raw, low = m[0], "".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in m[0])
        opens = not out or bool(re.search(r'[.!?\n:;"(\[{*]', text[after : m.start()]))
        number = raw[0] in "0123456789"
        unit = bool(out) and out[-1]["number"] and not opens and low in UNITS
        capital = raw[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or ("\xc0" <= raw[0] <= "\xde" and len(raw.encode()) > 2)
        name = capital and not opens and len(raw.encode()) > 1 and sum("A" <= c <= "Z" for c in raw) <= 1
        out.append({"number": number, "unit": unit, "name": name and not unit and not number, "low": low, "span": m.span()})
        after = m.end()
    typed = lambda t: "#" if t["number"] else "U" if t["unit"] else None
    forms = [[(typed(t) or ("N" if t["name"] else None) or t["low"], bool(typed(t)) or t["name"]) for t in out], [(typed(t) or t["low"], bool(typed(t))) for t in out], [(t["low"], False) for t in out]]
    return text.lower(), out, forms


def template_windows(text, size):
    """(place, form, key, slots) of the windows of a text."""
    low, tokens, forms = canonical(text)
    if size < 4:
        return [(p, 3, low[tokens[p]["span"][0] : tokens[p + size - 1]["span"][1]], []) for p in range(len(tokens) - size + 1) if size > 1 or len(tokens) == 1]
    found = []
    for p in range(len(tokens) - size + 1):
        keys = [tuple(k for k, _ in f[p : p + size]) for f in forms]
        fits = [2 * sum(s for _, s in f[p : p + size]) <= size for f in forms]
        for k, f in enumerate(forms):
            if fits[k] and not any(keys[j] == keys[k] and fits[j] for j in range(k)):
                found.append((p, k, keys[k], [t["low"] for t, (_, s) in zip(tokens[p : p + size], f[p : p + size], strict=True) if s]))
    return found


def contaminated_by(text, item, cover=0.5, consistent=0.8):
    n = len(canonical(item)[1])
    size = min(8, n)
    if not size:
        return False
    mine = template_windows(item, size)
    worded = {p for p, f, *_ in mine if f in (0, 3)}
    of, width, hits, seen = n - size + 1, max(2, n // 2), {}, set()
    for pos, form, key, found in template_windows(text, size):
        first = (key, *found) not in seen
        seen.add((key, *found))
        for at, f, k, slots in mine:
            if k == key and (form == 3) == (f == 3) and len(slots) == len(found):
                hits[at, pos] = min(hits.get((at, pos), (9,)), (form, first, slots, found))
    places = collections.defaultdict(list)
    for (at, pos), (_, first, slots, found) in hits.items():
        shift = pos - at
        for place in [(1, shift // width), (2, (shift + width // 2) // width)] + [(0, 0)] * first:
            places[place].append((at, slots, found))
    for rows in places.values():
        w, n = len({a for a, *_ in rows if a in worded}), len({a for a, *_ in rows})
        words = worded and w * of >= n * len(worded)
        votes = collections.defaultdict(collections.Counter)
        for _, slots, found in rows:
            for s, f in zip(slots, found, strict=True):
                votes[s][f] += 1
        best, total = sum(max(c.values()) for c in votes.values()), sum(sum(c.values()) for c in votes.values())
        if (w >= cover * len(worded) if words else n >= cover * of) and best >= consistent * total:
            return True
    return False


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_contamination_matches_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
    rng = random.Random(12)
    names, units = ["Anna", "Bob", "\u00c9mile", "Zo\u00eb", "McKay"], sorted(UNITS)[:6]

    def token():
        r = rng.random()
        return rng.choice(names) if r < 0.15 else str(rng.randint(1, 30)) + rng.choice(["", ".5", ",", " " + rng.choice(units)]) if r < 0.35 else rng.choice(["red", "house", "walks", "Then", "\u00fcber", "of", "the", "a"]) + rng.choice(["", "", "", ".", ":", "?", " \u201c", " \u2013"])

    items = [" ".join(token() for _ in range(n)) for n in (1, 2, 3, 4, 6, 8, 9, 12, 20, 30, 45) for _ in range(2)] + ["house of the", ""]
    rows = [(1, None), (2, ""), (3, "house of the")]
    for k in range(90):
        out = []
        for _ in range(rng.randint(1, 5)):
            copy = rng.choice(items).split(" ")
            for _ in range(rng.randint(0, 3) if len(copy) > 3 else 0):
                at = rng.randrange(len(copy))
                copy[at] = token() if rng.random() < 0.5 else re.sub(r"\d+", str(rng.randint(1, 30)), copy[at])
            text = " ".join(copy)
            out += [rng.choice([str, str.lower, str.upper])(text) if rng.random() < 0.3 else text, " ".join(token() for _ in range(rng.randint(0, 40)))]
        rows.append((10 + k, " ".join(out)))
    bench = spark.createDataFrame([*enumerate(items), (3, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark, rows), bench).collect()}
    want = {(d, k) for d, t in rows for k, i in enumerate(items) if t and contaminated_by(t, i)}
    assert got == want and len(want) > 100


def test_benchmark_passages_are_found(spark):
    docs, items = documents(spark), [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, s in items if s in (t or "")}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op6_decontamination"](spark, SF).collect()}
    assert want and want <= got


# 7 sharding


def test_sharding(spark, odd):
    rng = random.Random(3)
    rows = odd + [(1000 + k, prose(rng, 30)) for k in range(400)] + [(3000 + k, "the same text") for k in range(30)]
    got = sharding.shard_documents(table(spark, rows), 8).collect()
    assert len(got) == len(rows)
    slots, shards = collections.defaultdict(list), collections.defaultdict(set)
    texts = dict(rows)
    for r in got:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
        slots[r.shard].append(r.slot)
        shards[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert len(shards[b"the same text"]) == 1
    assert sharding.shard_documents(table(spark, [])).count() == 0


def placed(shares, shards):
    """The rule item by item, without arrays."""
    room, out = [[1 / shards] * 3 for _ in range(shards)], [0] * len(shares)
    for k in sorted(range(len(shares)), key=lambda k: (-max(shares[k]), k)):
        dots = [sum(a * b for a, b in zip(r, shares[k], strict=True)) for r in room]
        best = max(range(shards), key=lambda s: (round(dots[s], 15), -s))
        out[k] = best
        room[best] = [a - b for a, b in zip(room[best], shares[k], strict=True)]
    return out


def test_placing_is_even():
    rng = np.random.default_rng(0)
    items = rng.pareto(2, (4000, 3))
    items /= items.sum(0)
    where = sharding.place(items, np.full((10, 3), 0.1))
    sums = np.array([items[where == k].sum(0) for k in range(10)])
    assert sums.max() < 0.105 and sums.min() > 0.095
    few = items[:60] / items[:60].sum(0)
    assert sharding.place(few, np.full((7, 3), 1 / 7)).tolist() == placed(few.tolist(), 7)


@pytest.mark.parametrize("small", [400, 1])
def test_shards_are_even(spark, small, monkeypatch):
    monkeypatch.setattr(sharding, "SMALL", small)  # 1: nearly all groups are placed by tasks
    rng = random.Random(7)
    rows = [(k, "one text of many rows") for k in range(1500)] + [(9, "again and again")] * 900 + [(5000 + k, "") for k in range(600)]
    rows += [(7000 + k, prose(rng, min(400, int(rng.lognormvariate(3, 1))))) for k in range(3000)]
    got = sharding.shard_documents(table(spark, rows), 10).collect()
    size, count, where = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for r in got:
        size[r.shard] += r.size
        count[r.shard] += 1
        where[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / 10
    assert len(got) == len(rows) and max(size.values()) < 1.05 * mean and min(size.values()) > 0.95 * mean
    assert max(count.values()) < 1.25 * len(rows) / 10 and min(count.values()) > 0.75 * len(rows) / 10
    assert sum(len(x) > 1 for x in where.values()) == 3
    for k in range(10):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(count[k]))


# 9 suffix dedup


def cut(rows, size):
    count, out = collections.Counter(), collections.Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        count.update(b[i : i + size] for i in range(len(b) - size + 1))
    for (doc_id, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        runs = len(re.findall(b"\1+", gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("size", [200, 120])
def test_suffix_dedup(spark, size):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(900))
    rows = [(1, None), (2, ""), (3, "ab" * 400), (4, base), (4, base), (None, base[:350] + "x" + base[351:]), (7, base[100:299]), (8, base[100:300]), (9, "q" + base[100:303] + "z"), (10, "é" * 100), (11, "é" * 99 + "a"), (12, "x" * 5000)]
    for k in range(40):
        a = rng.randrange(800)
        rows.append((20 + k, "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + base[a : a + rng.randrange(150, 420)] + "".join(rng.choice("xyz") for _ in range(50))))
    got = suffix_dedup.remove_repeats(table(spark, rows), size).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert collections.Counter(map(tuple, got)) == cut(rows, size)


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    t = [rng.integers(0, 40, 5000), rng.integers(0, 1000, 5000)]
    order = suffix_dedup.multikey_quicksort(t, small=16)
    assert np.array_equal(np.stack(t)[:, order], np.stack(t)[:, np.lexsort(t[::-1])])


def test_no_repeats(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    docs = table(spark, [(1, "a" * 500), (2, "short"), (3, None)])
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and {(r.doc_id, r.text, r.n_chars) for r in left.collect()} == {(2, "short", 5), (3, "", 0)}


# 10 WARC


@pytest.mark.parametrize("small", [False, True])
def test_warc(spark, small, monkeypatch):
    if small:
        for name, value in (("RUN", 3), ("LINES", 2), ("FAN", 2)):
            monkeypatch.setattr(warc, name, value)
    big = "<p>" + "é" * 700 + "</p>"
    rows = [(1, "http://www.A.com:80/x?b=1#f", big), (2, None, big), (3, "https://a.com/x", "small"), (4, "https://a.com/x", "small"), (5, "not a url", None), (6, "http://b.org/", big + " "), (7, "http://a.com/y", big), (7, "http://a.com/y", big), (None, "http://c.com", big), (9, "http://[bad", "")]
    rows += [(100 + k, f"http://s{k % 5}.net/{k * 37 % 11}", f"page {k}") for k in range(40)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index, records = warc.archive_pages(spark, pages)
    found = records.collect()
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found)
    want = collections.Counter()
    for page_id, _, html in rows:
        b = (html or "").encode()
        refers = 7 if html == big and page_id != 7 else None
        want[page_id, len(b), hashlib.sha1(b).hexdigest(), "revisit" if refers else "response", refers] += 1
    assert got == want
    stamp = lambda i: (datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    order = sorted((warc.url_key(u), stamp(i), -1 if i is None else i) for i, u, _ in rows)
    entries = sorted(index.collect(), key=lambda r: r.position)
    assert [r.position for r in entries] == list(range(len(rows))) and [(r.key, r.stamp, r.page_id) for r in entries] == order
    assert [(r.url_key, r.capture_stamp) for r in sorted(found, key=lambda r: r.position)] == [x[:2] for x in order]
    assert warc.archive_pages(spark, pages.limit(0))[1].count() == 0


def test_loser_tree_and_keys():
    rng = random.Random(1)
    for k in range(1, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)
    assert list(warc.LoserTree([])) == []
    assert warc.url_key("http://www.A.com:80/x?b=1#f") == "com,a)/x?b=1" == warc.url_key("https://a.com/x?b=1")


# Pipeline


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, ids = dict(documents(spark)), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            ids.append({r.doc_id for r in docs.collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 100
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(s in (r.text or "") for r in docs.collect() for s in items)
    near = linked([(i, texts[i]) for i in sorted(ids[0])], 5, 80)
    assert {k[0] for k in near if k[3]} == ids[1]
    assert {r.doc_id for r in out.collect()} == ids[-1]


def test_pipeline_of_odd_rows(spark, tmp_path, odd):
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = odd + [(3, None), (50, benchmark[0]), (51, "Before it. " + benchmark[1] + " After it."), (None, None), (None, "one more text without an id")]
    for name, docs in (("odd", table(spark, rows)), ("none", table(spark, []))):
        before, start = None, docs.columns
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, SF)
            path = str(tmp_path / f"{name}-{k}")
            out.write.parquet(path)
            found = spark.read.parquet(path).collect()
            if stage == "packing":
                assert collections.Counter(r.doc_id for r in found if r.piece == 0) == before
                continue
            assert out.columns == start
            now = collections.Counter(r.doc_id for r in found)
            assert before is None or now <= before
            assert stage != "near_dedup" or now[4] + now[3] <= 2 and now[10] <= 1
            assert stage != "decontamination" or not now[50] + now[51]
            before, docs = now, spark.read.parquet(path)
        assert name == "odd" or not before


def test_queries_are_registered():
    from __spark_entry__ import oracle_sql, queries as all_queries

    names = all_queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(oracle_sql()) <= set(names)
    assert os.path.isdir(SF) and glob.glob(f"{SF}/*.parquet")
