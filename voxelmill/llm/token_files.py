"""Token ids in seekable files of independent zstandard frames (operator 8).

A file holds, in order:

* data frames: each an independent zstandard frame with its content checksum, of the ids
  (little-endian unsigned 32-bit) of one or more whole documents;
* one skippable frame with the document index: for each document its id, its number of ids and its data frame;
* the seek table, a skippable frame as the public seekable-format description has it: for each frame the compressed
  and the decompressed size and the low 32 bits of XXH64 of its content, then the number of frames, a flag byte
  and the closing magic number.

A reader takes the seek table from the end, then the index, then only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialise, new_folder, partitions, slices, table
from .tokens import encoder

# Fixed values of the zstandard seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 1 << 18
END_OF_TEXT = 0


def filesystem(uri: str):
    """The file system and path of a URI, for tasks that write or read files of their own format."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class Writer:
    def __init__(self, out):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.table, self.docs, self.held, self.size = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > FRAME_BYTES:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4, len(self.table)))
        self.held.append(ids)
        self.size += len(ids)

    def _put(self, raw: bytes) -> bytes:
        packed = self.pack.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return packed

    def _flush(self) -> None:
        if self.held:
            self.out.write(self._put(b"".join(self.held)))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        kinds = ("<i8", "u1", "<u8", "<u4")
        columns = zip(*self.docs, strict=True) if self.docs else [()] * 4
        raw = b"".join(np.array(c, k).tobytes() for c, k in zip(columns, kinds, strict=True))
        index = self.pack.compress(struct.pack("<Q", len(self.docs)) + raw)
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = b"".join(struct.pack("<III", *row) for row in self.table)
        entries += struct.pack("<II", 8 + len(index), 0) + struct.pack("<I", 0)
        footer = struct.pack("<IBI", len(self.table) + 1, CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + len(footer)) + entries + footer)


class Reader:
    """Reads documents of one file by their place in it."""

    def __init__(self, file):
        self.file, size = file, file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a seekable token file")
        self.table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        packed = self._at(int(self.offsets[-2]) + 8, int(self.table[-1, 0]) - 8)
        raw = zstandard.ZstdDecompressor().decompress(packed)
        (n,) = struct.unpack_from("<Q", raw)
        at = 8
        found = []
        for kind in ("<i8", "u1", "<u8", "<u4"):
            found.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.ids, self.null, self.lengths, self.frames = found
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        packed, size, check = (int(x) for x in self.table[k])
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), packed), max_output_size=max(1, size))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, places: Iterable[int] | None = None) -> Iterator[tuple[int, bytes]]:
        """(place, ids) of the documents at these places (all by default); frames without any are not read."""
        places = range(len(self.ids)) if places is None else sorted(places)
        now, raw, base = -1, b"", 0
        for p in places:
            if (k := int(self.frames[p])) != now:
                now, raw, base = k, self.frame(k), int(self.starts[np.searchsorted(self.frames, k)])
            a = (int(self.starts[p]) - base) * 4
            yield p, raw[a : a + 4 * int(self.lengths[p])]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, spaces: str = "leading", end: int = END_OF_TEXT) -> DataFrame:
    """Writes the ids of whole texts, with ``end`` after each document, in ascending doc_id order over all files.

    Each range of doc_ids makes one file. A task writes under a name of its own attempt, and only files of
    successful attempts are listed in the result: path, part, n_docs, n_tokens.
    Null texts are empty documents of one id; rows with equal doc_ids follow each other by a hash of the text, null ids come first. A very long text is encoded
    whole by its task and is a frame of its own; an empty table gives no file.
    """
    stop = np.array([end], "<u4").tobytes()

    def write(batches):
        context = TaskContext.get()
        fs, path = filesystem(f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.zst")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        encode, n_docs, n_tokens, out = encoder(tokenizer, spaces).encode_column, 0, 0, None
        for batch in slices(batches, True):
            if out is None:
                out = fs.open_output_stream(path, compression=None)
                writer = Writer(out)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                writer.add(doc_id, ids + stop)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(ids) // 4 + 1
        if out is not None:
            writer.close()
            out.close()
            uri = f"{folder}/{path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_pydict({"path": [uri], "part": [context.partitionId()], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    # Rows that share an id, and rows that are equal, are dealt over as many ranges as they need.
    order = [F.col("doc_id").asc_nulls_first(), "h", "u"]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("u"))
    ranged = keyed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop("h", "u")
    return materialise(ranged.mapInArrow(write, "path string, part long, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every document. Only the list of files passes through the driver."""
    files, start = [], 0
    for row in sorted(manifest.collect(), key=lambda r: r.part):
        files.append((row.path, start))
        start += row.n_tokens

    def read(batches):
        for batch in batches:
            for uri, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    r = Reader(file)
                    held, size = [], 0
                    for p, ids in r.documents():
                        held.append((None if r.null[p] else int(r.ids[p]), first + int(r.starts[p]), int(r.lengths[p]), ids))
                        size += len(ids)
                        if size > 1 << 22:
                            yield rows(held)
                            held, size = [], 0
                    if held:
                        yield rows(held)

    def rows(held):
        a, b, c, d = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    out = read_token_files(spark, manifest)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


