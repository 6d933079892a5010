"""Quality classifier on random-indexing word vectors (operator 5).

* Words fall into WORDS hash slots and their forms (case, digits, punctuation, repetition) into FORMS further slots. Each slot has a
  fixed sparse ternary index vector. A slot's context vector is the sum of the index vectors of its neighbours
  over all texts of the corpus. The tables of slots have a fixed size, however large the corpus.
* A document is the mean of its words' context vectors, of its forms' context vectors and of its forms' index vectors.
* A two-layer network in NumPy is fitted on the driver to at most SAMPLE labelled documents, and the temperature of its
  logits to a fifth of them that it didn't see.

The sample bound is the only one; the vectors come from all texts and all documents are scored. Very long texts are read in
pieces of a MB; words on both sides of a cut aren't neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import Buffer, as_bytes, chunks, pieces
from .scratch import partitions, slices, table

WORDS, FORMS, DIM, NONZERO, WINDOW = 1 << 14, 1 << 10, 32, 4, 2
SLOTS, SLICES = WORDS + FORMS, 17
SAMPLE, HIDDEN, EPOCHS, SEED = 20_000, 32, 40, 11
WIDTH = 3 * DIM


def index_vectors() -> np.ndarray:
    """Of each slot NONZERO entries of +1 or -1, the rest 0."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, DIM), np.float32)
    at = np.argsort(rng.random((SLOTS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (SLOTS, NONZERO)), axis=1)
    return out


def _slots(buf: Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots and form slots of all words of a buffer, and the number of words before each text."""
    words, start, end, at = buf.words(lower=False)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at
    b = buf.bytes
    upper = np.concatenate([[0], np.cumsum((b >= 65) & (b <= 90))])
    digit = np.concatenate([[0], np.cumsum((b >= 48) & (b <= 57))])
    letter = ((b | 32) >= 97) & ((b | 32) <= 122) | (b >= 128)
    mark = ~letter & ~((b >= 48) & (b <= 57))
    marks = np.concatenate([[0], np.cumsum(np.where(mark, 1 + (b.astype(np.int64) * 7) % 29, 0))])
    n_up, n_mark = upper[end] - upper[start], marks[end] - marks[start]
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    case = np.where(n_up == 0, 0, np.where(n_up == 1, 1, 2))
    form = case + 3 * (digit[end] > digit[start]) + 6 * same + 12 * np.minimum(n_mark, 84)
    return (words & np.uint64(WORDS - 1)).astype(np.int64), WORDS + form, at


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' index vectors over a task's texts, in SLICES rows."""
    index = index_vectors()
    place = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
    sign = np.take_along_axis(index, place, 1)
    total = np.zeros(SLOTS * DIM)

    def add(of, near):
        cells = (of[:, None] * DIM + place[near]).ravel()
        np.add(total, np.bincount(cells, sign[near].ravel(), minlength=len(total)), out=total)

    for batch in slices(batches):
        texts, _ = pieces(as_bytes(batch.column("text").to_pylist()))
        for a, b in chunks(texts):
            word, form, at = _slots(Buffer(texts[a:b]))
            owner = np.searchsorted(at, np.arange(len(word)), side="right")
            for gap in range(1, WINDOW + 1):
                pair = owner[gap:] == owner[:-gap]
                for kind in (word, form):
                    left, right = kind[:-gap][pair], kind[gap:][pair]
                    add(np.concatenate([left, right]), np.concatenate([right, left]))
    sums = total.astype(np.int64).reshape(SLICES, -1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([s.tobytes() for s in sums])], names=["slice", "sums"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(raw, np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()])], names=["slice", "sums"])


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Unit context vectors of all slots, from all texts: a table of fixed size. Whole-number sums are added up in two rounds of tasks."""
    n = partitions(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_contexts, "slice int, sums binary")
    part = F.pmod(F.monotonically_increasing_id() % 1009, F.lit(max(1, n // SLICES)))
    rows = rows.withColumn("part", part).repartition(n, "slice", "part").mapInArrow(lambda it: _add_up(b.select(["slice", "sums"]) for b in it), "slice int, sums binary")
    out = np.zeros((SLICES, SLOTS * DIM // SLICES), np.int64)
    for r in rows.repartition(SLICES, "slice").mapInArrow(_add_up, "slice int, sums binary").toLocalIterator():
        out[r[0]] += np.frombuffer(bytes(r[1]), np.int64)
    out = out.reshape(SLOTS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(texts: list[bytes], context: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The pooled vectors of texts, zero for those without words."""
    out, words = np.zeros((len(texts), WIDTH), np.float32), np.zeros(len(texts), np.int64)
    cut, owner = pieces(texts)
    for a, b in chunks(cut):
        word, form, at = _slots(Buffer(cut[a:b]))
        n = np.diff(at)
        some = np.flatnonzero(n)
        if len(some):
            words_of = owner[a + some]
            np.add.at(words, words_of, n[some])
            for k, (source, slot) in enumerate(((context, word), (context, form), (index, form))):
                np.add.at(out[:, k * DIM : (k + 1) * DIM], words_of, np.add.reduceat(source[slot], at[some], axis=0))
    return out / np.maximum(words, 1)[:, None].astype(np.float32)


class Network:
    """Standardised inputs, one hidden layer of tanh, a logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        cut = len(x) // 5
        aside, fit = order[:cut], order[cut:]
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        self.temperature = 1.0
        names = ("w1", "b1", "w2", "b2")
        m, v, step = {k: 0 for k in names}, {k: 0 for k in names}, 0
        for _ in range(EPOCHS):
            rng.shuffle(fit)
            for a in range(0, len(fit), 256):
                rows = fit[a : a + 256]
                h = np.tanh(x[rows] @ self.w1 + self.b1)
                g = (_sigmoid(h @ self.w2 + self.b2) - y[rows]) / len(rows)
                back = np.outer(g, self.w2) * (1 - h**2)
                grads = {"w2": h.T @ g, "b2": g.sum(keepdims=True), "w1": x[rows].T @ back + 1e-4 * self.w1, "b1": back.sum(0)}
                step += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * grads[k]
                    v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                    now = getattr(self, k)
                    setattr(self, k, now - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        if cut:
            logits = self._logits(x[aside])
            grid = np.exp(np.linspace(-2, 3, 101))
            self.temperature = float(min(grid, key=lambda t: _loss(logits / t, y[aside])))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logits((x - self.mean) / self.scale) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


class Classifier:
    """Fitted to the labels of some documents and the texts of all.

    Only labels of documents that aren't held out are learnt, at most ``sample`` of them, chosen by a hash of the id. Several labels of a document are
    averaged, of several texts with one id that of the least vector counts; null labels and labels without a document are passed over. With one kind of label or none every score is that label's, or 1.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
        spark = docs.sparkSession
        docs = docs.select("doc_id", "text")
        self.contexts = spark.sparkContext.broadcast(context_vectors(docs))  # a table of fixed size
        known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
        known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        contexts = self.contexts

        def vectors(batches):
            index = index_vectors()
            for batch in slices(batches):
                x = pool(as_bytes(batch.column("text").to_pylist()), contexts.value, index)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

        rows = docs.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text").mapInArrow(vectors, "doc_id long, y int, x binary")
        rows = rows.groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # a row of each labelled id, so ``sample`` at most
        y = np.array([r.y for r in rows], float)
        self.only = float(y[0]) if len(y) else 1.0
        self.network = None
        if len(set(y.tolist())) == 2:
            x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, WIDTH).astype(float)
            self.network = Network(x, y)

    def scorer(self):
        """A function from texts to scores, to be used inside tasks."""
        contexts, network, only = self.contexts, self.network, self.only
        index = index_vectors()

        def score(texts: list[bytes]) -> np.ndarray:
            if network is None:
                return np.full(len(texts), only)
            return network.score(pool(texts, contexts.value, index).astype(float))

        return score


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    Null and empty texts have a zero vector and the score the network gives it; a null doc_id is scored and not held out; repeated rows are scored each.
    Neither labels nor any column but the text enter a score.
    """
    score = Classifier(docs, labels, sample).scorer()

    def apply(batches):
        for batch in slices(batches):
            scores = score(as_bytes(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, score double")
    flag = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return out.select("doc_id", flag.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least a half, with all their columns."""
    score = Classifier(docs, labels).scorer()

    def keep(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(score(as_bytes(batch.column("text").to_pylist())) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


