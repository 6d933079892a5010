"""NIfTI volumes and channel packs as Spark data sources: ``spark.read.format("voxel-nifti")`` and ``"voxel-pack"``, and their writers.

Reading: partitions are planned from headers and indexes alone. An uncompressed volume is cut into runs of slices that tasks seek to; filters on volume_id,
z and channel are pushed down to the plan of partitions, so that nothing else is opened.

Writing: a task writes each volume or shard under a name of its own attempt and reports it with its size and SHA-256. The driver's commit writes the index
last; readers take files from the index alone, so what a failed or repeated task left never shows. A task that fails deletes its files, an aborted job
all that were reported.
"""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from . import nifti, pack

INDEX = "index.json"
#: Bytes of values of an uncompressed volume that one task reads.
PART_BYTES = 32 << 20
_VOXELS = "volume_id string, vid long, x int, y int, z int, value double"
_CHANNELS = "channel int, x int, y int, z int, t float"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NiftiSource)
    spark.dataSource.register(PackSource)


def _flag(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: entries of the index."""

    entries: list


@dataclass
class Piece(InputPartition):
    """A run of slices [z0, z1) of a volume, or some channels of a shard."""

    file: str
    name: str
    z0: int = 0
    z1: int = 0
    channels: tuple = ()
    checksum: str = ""


class _Filters:
    """Bounds that pushed filters set on one name column and one number column."""

    def __init__(self, name: str | None, number: str):
        self.name, self.number = name, number
        self.names: set | None = None
        self.low, self.high, self.numbers = -np.inf, np.inf, None

    def take(self, f) -> bool:
        """Whether the filter is now part of the plan of partitions in full."""
        column = f.attribute[0] if len(f.attribute) == 1 else None
        if isinstance(f, IsNotNull):
            return True  # no column has nulls
        if isinstance(f, (EqualTo, In)) and column in (self.name, self.number):
            values = set(f.value) if isinstance(f, In) else {f.value}
            held = "names" if column == self.name else "numbers"
            setattr(self, held, values if getattr(self, held) is None else getattr(self, held) & values)
            return True
        if column == self.number and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            return True
        if column == self.number and isinstance(f, (LessThan, LessThanOrEqual)):
            self.high = min(self.high, f.value - isinstance(f, LessThan))
            return True
        return False

    def has_name(self, v: str) -> bool:
        return self.names is None or v in self.names

    def has(self, n: int) -> bool:
        return self.low <= n <= self.high and (self.numbers is None or n in self.numbers)


def _index(options) -> dict | None:
    store, path = _store(options["path"])
    with contextlib.suppress(FileNotFoundError), store.open_input_stream(f"{path}/{INDEX}", compression=None) as f:
        return json.loads(f.read())
    return None


class _Reader(DataSourceReader):
    def __init__(self, options, filters: _Filters):
        self.options, self.filters = options, filters

    def pushFilters(self, filters):  # noqa: N802  the interface's name
        for f in filters:
            if not (hasattr(f, "attribute") and self.filters.take(f)):
                yield f


class NiftiReader(_Reader):
    def _head(self, store, file: str) -> dict:
        with store.open_input_stream(file, compression=None) as f:
            raw = f.read(nifti.DATA_AT)
            if raw[:2] == b"\x1f\x8b":
                f.close()
                with store.open_input_stream(file, compression="gzip") as g:
                    return nifti.header(g.read(nifti.DATA_AT)) | {"packed": True}
        return nifti.header(raw) | {"packed": False}

    def partitions(self):
        from pyarrow import fs

        store, path = _store(self.options["path"])
        listed = _index(self.options)
        if listed is not None:
            files = [(f"{path}/{e['filename']}", e["id"], e["checksum"]) for e in listed["volumes"]]
        else:
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
            files = [(f.path, f.base_name, "") for f in found if f.is_file and f.base_name.lower().endswith((".nii", ".nii.gz")) and not f.base_name.startswith(".")]
        out = []
        for file, name, checksum in sorted(files):
            if not self.filters.has_name(name):
                continue
            h = self._head(store, file)
            slices = [z for z in range(h["dims"][2]) if self.filters.has(z)]
            if not slices:
                continue
            size = h["dims"][0] * h["dims"][1] * np.dtype(nifti.DTYPES[h["code"]]).itemsize
            step = h["dims"][2] if h["packed"] else max(1, int(self.options.get("bytes", PART_BYTES)) // size)
            for a in range(slices[0], slices[-1] + 1, step):
                b = min(a + step, slices[-1] + 1)
                if any(a <= z < b for z in slices):
                    out.append(Piece(file, name, a, b, checksum=checksum if h["packed"] else ""))
        return out or [Piece("", "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        store, _ = _store(self.options["path"])
        h = self._head(store, piece.file)
        nx, ny, nz = h["dims"]
        kind = np.dtype(h["order"] + nifti.DTYPES[h["code"]])
        if h["packed"]:
            with store.open_input_stream(piece.file, compression=None) as f:
                raw = f.read()
            _verify(raw, piece)
            file = io.BytesIO(gzip.decompress(raw))
        else:
            file = store.open_input_file(piece.file)
        with file:
            for z in range(piece.z0, piece.z1):
                if not self.filters.has(z):
                    continue
                file.seek(h["offset"] + z * nx * ny * kind.itemsize)
                raw = file.read(nx * ny * kind.itemsize)
                if len(raw) < nx * ny * kind.itemsize:
                    raise ValueError(f"{piece.name} is shorter than its grid")
                value = np.frombuffer(raw, kind).astype(float)
                if _flag(self.options, "scaled"):
                    value = value * h["slope"] + h["inter"]
                at = np.flatnonzero(value) if _flag(self.options, "nonzero") else np.arange(nx * ny)
                columns = [at + z * nx * ny, (at % nx).astype(np.int32), (at // nx).astype(np.int32), np.full(len(at), z, np.int32), value[at]]
                yield pa.RecordBatch.from_arrays([pa.array([piece.name] * len(at), pa.string()), *map(pa.array, columns)], names=["volume_id", "vid", "x", "y", "z", "value"])


class PackReader(_Reader):
    def partitions(self):
        described = _index(self.options)
        if described is None:
            raise FileNotFoundError(f"no {INDEX} in {self.options['path']}")
        described = pack.index(json.dumps(described))
        out = []
        for s in described["shards"]:
            wanted = tuple(c for c in map(int, s["channelLabels"]) if self.filters.has(c))
            if wanted:
                out.append(Piece(s["filename"], s["id"], channels=wanted, checksum=s["checksum"]))
        return out or [Piece("", "")]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.file:
            return
        described = pack.index(json.dumps(_index(self.options)))
        labels = [int(c) for s in described["shards"] if s["filename"] == piece.file for c in s["channelLabels"]]
        dims = described["shape"][1:]
        size, half = int(np.prod(dims)), described.get("dtype") == "float16"
        store, path = _store(self.options["path"])
        with store.open_input_stream(f"{path}/{piece.file}", compression=None) as f:
            raw = f.read()
        _verify(raw, piece)
        values = pack.half_floats(raw) if half else np.frombuffer(raw, "<f4")
        if len(values) != size * len(labels):
            raise ValueError(f"shard {piece.name} doesn't fit its index")
        order = "F" if described["voxelOrder"] in pack.FORTRAN else "C"
        place = [p.astype(np.int32) for p in np.unravel_index(np.arange(size), dims, order=order)]
        for c in piece.channels:
            k = labels.index(c)
            part = values[k * size : (k + 1) * size]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, c, np.int32)), *map(pa.array, place), pa.array(part)], names=["channel", "x", "y", "z", "t"])


def _verify(raw: bytes, piece: Piece) -> None:
    if piece.checksum and piece.checksum != f"sha256:{hashlib.sha256(raw).hexdigest()}":
        raise ValueError(f"{piece.name}: the file differs from the index's checksum")


class _Writer(DataSourceArrowWriter):
    """Rows come grouped by what makes a file; ``files`` turns each group into (id, suffix, content, more entries of the index)."""

    key = ""

    def __init__(self, options, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def files(self, name, batches: list[pa.Table]):
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = _store(self.options["path"])
        store.create_dir(path, recursive=True)
        entries, seen = [], set()
        try:
            for name, tables in _groups(iterator, self.key):
                if name in seen:
                    raise ValueError(f"rows of {name} come apart; sort them by {self.key}")
                seen.add(name)
                label, suffix, content, more = self.files(name, pa.concat_tables(tables))
                file = f"{label}-{uuid.uuid4().hex}{suffix}"
                entries.append({"id": label, "filename": file, "sizeBytes": len(content), "checksum": f"sha256:{hashlib.sha256(content).hexdigest()}", **more})
                with store.open_output_stream(f"{path}/{file}", compression=None) as out:
                    out.write(content)
        except BaseException:
            _delete(store, path, entries)
            raise
        return Written(entries)

    def head(self) -> dict:
        return {}

    def commit(self, messages) -> None:
        store, path = _store(self.options["path"])
        entries = sorted((e for m in messages if m for e in m.entries), key=lambda e: e["id"])
        ids = [e["id"] for e in entries]
        if len(set(ids)) < len(ids):
            self.abort(messages)
            raise ValueError(f"several tasks wrote {sorted({i for i in ids if ids.count(i) > 1})[:3]}; deal the rows by {self.key}")
        old = _index(self.options)
        if old is not None and not self.overwrite:
            entries = sorted(old[self.listed] + entries, key=lambda e: e["id"])
        index = self.head() | {self.listed: entries}
        store.create_dir(path, recursive=True)
        part = f"{path}/.{INDEX}-{uuid.uuid4().hex}"
        with store.open_output_stream(part, compression=None) as out:
            out.write(json.dumps(self.complete(index), indent=2).encode())
        store.move(part, f"{path}/{INDEX}")
        if old is not None and self.overwrite:
            _delete(store, path, old[self.listed])

    def complete(self, index: dict) -> dict:
        return index

    def abort(self, messages) -> None:
        store, path = _store(self.options["path"])
        for m in messages:
            if m:
                _delete(store, path, m.entries)


def _delete(store, path: str, entries: list[dict]) -> None:
    for e in entries:
        with contextlib.suppress(FileNotFoundError):
            store.delete_file(f"{path}/{e['filename']}")


def _groups(batches: Iterator[pa.RecordBatch], key: str):
    def runs():
        for b in batches:
            table = pa.Table.from_batches([b])
            ends = np.flatnonzero(np.r_[True, (v := np.array(b.column(key).to_pylist(), object))[1:] != v[:-1]]) if b.num_rows else []
            for a, z in zip(ends, [*ends[1:], b.num_rows], strict=True):
                yield v[a], table.slice(a, z - a)

    for name, parts in groupby(runs(), key=lambda r: r[0]):
        yield name, [t for _, t in parts]


class NiftiWriter(_Writer):
    """Options: dims ("16x16x16") and affine (JSON, optional) of all volumes, labels, compress (default true)."""

    key, listed = "volume_id", "volumes"

    def files(self, name, rows: pa.Table):
        data = np.zeros([int(n) for n in self.options["dims"].split("x")])
        data[tuple(rows[c].to_numpy() for c in "xyz")] = rows["value"].to_numpy()
        affine = json.loads(self.options["affine"]) if "affine" in self.options else None
        raw = nifti.encode(data, affine, _flag(self.options, "labels"))
        packed = str(self.options.get("compress", "true")).lower() == "true"
        return name, ".nii.gz" if packed else ".nii", gzip.compress(raw, mtime=0) if packed else raw, {}


class PackWriter(_Writer):
    """Options: dims ("4x4x4"). Rows: shard, channel, x, y, z, t; half floats in row-major order."""

    key, listed = "shard", "shards"

    def files(self, name, rows: pa.Table):
        channel = rows["channel"].to_numpy()
        labels, at = np.unique(channel, return_inverse=True)
        out = np.zeros((len(labels), *(int(n) for n in self.options["dims"].split("x"))), "<f2")
        out[(at, *(rows[c].to_numpy() for c in "xyz"))] = rows["t"].to_numpy()
        return f"{int(name):06d}", ".bin", out.tobytes(), {"channelLabels": [str(c) for c in labels]}

    def head(self) -> dict:
        dims = [int(n) for n in self.options["dims"].split("x")]
        return {"dtype": "float16", "shape": [0, *dims], "voxelsPerMap": int(np.prod(dims)), "voxelOrder": "row-major"}

    def complete(self, index: dict) -> dict:
        labels = [c for s in index["shards"] for c in s["channelLabels"]]
        return index | {"shape": [len(labels), *index["shape"][1:]], "channelLabels": labels}


class NiftiSource(DataSource):
    """Options: path; for reading scaled, nonzero, bytes; for writing those of NiftiWriter."""

    @classmethod
    def name(cls) -> str:
        return "voxel-nifti"

    def schema(self) -> str:
        return _VOXELS

    def reader(self, schema):
        return NiftiReader(self.options, _Filters("volume_id", "z"))

    def writer(self, schema, overwrite: bool):
        return NiftiWriter(self.options, overwrite)


class PackSource(DataSource):
    """Options: path; for writing dims."""

    @classmethod
    def name(cls) -> str:
        return "voxel-pack"

    def schema(self) -> str:
        return _CHANNELS

    def reader(self, schema):
        return PackReader(self.options, _Filters(None, "channel"))

    def writer(self, schema, overwrite: bool):
        return PackWriter(self.options, overwrite)


def save_volumes(volumes: DataFrame, path: str, dims, affine=None, mode: str = "overwrite", **options) -> None:
    """Volumes of one grid as a folder of NIfTI files with an index. A volume is one file, so its values are in one task."""
    rows = volumes.select("volume_id", *(F.col(c).cast("int").alias(c) for c in "xyz"), F.col("value").cast("double").alias("value"))
    out = rows.repartition("volume_id").sortWithinPartitions("volume_id").write.format("voxel-nifti").mode(mode).option("dims", "x".join(map(str, dims)))
    if affine is not None:
        out = out.option("affine", json.dumps(np.asarray(affine, float).tolist()))
    out.options(**options).save(path)


def save_pack(maps: DataFrame, path: str, dims, per_shard: int = pack.CHANNELS_A_SHARD, mode: str = "overwrite") -> None:
    """Maps (channel, x, y, z, t) as a folder of shards of ``per_shard`` channels of half floats with an index."""
    shard = F.floor((F.col("channel") - 1) / per_shard).cast("int").alias("shard")
    rows = maps.select(shard, F.col("channel").cast("int").alias("channel"), *(F.col(c).cast("int").alias(c) for c in "xyz"), F.col("t").cast("float").alias("t"))
    rows.repartition("shard").sortWithinPartitions("shard").write.format("voxel-pack").mode(mode).option("dims", "x".join(map(str, dims))).save(path)
