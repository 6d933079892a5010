"""NIfTI-1 volumes as tables: files are listed and read by Spark, each volume is decoded in the task that reads it."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the NIfTI-1 format: datatype codes.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER, DATA_AT = 348, 352
META = "volume_id string, nx int, ny int, nz int, datatype int, affine array<array<double>>, header binary"
VOXELS = "volume_id string, vid long, x int, y int, z int, value double"


def decompress(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def header(raw: bytes) -> dict:
    """Byte order, dims, type, scaling, offset and affine; 4-D is accepted only with one volume."""
    order = "<" if struct.unpack_from("<i", raw)[0] == HEADER else ">"
    get = lambda kind, at, n=1: struct.unpack_from(f"{order}{n}{kind}", raw, at)
    if get("i", 0)[0] != HEADER:
        raise ValueError("not a NIfTI-1 file")
    dim = get("h", 40, 8)
    if dim[0] not in (3, 4) or (dim[0] == 4 and dim[4] not in (0, 1)):
        raise ValueError(f"a volume of three dimensions is needed, not {dim[1 : 1 + dim[0]]}")
    code = get("h", 70)[0]
    if code not in DTYPES:
        raise ValueError(f"datatype {code} is not supported")
    pixdim = get("f", 76, 8)
    size = [abs(p) or 1.0 for p in pixdim[1:4]]
    slope, inter = get("f", 112, 2)
    out = {"order": order, "dims": dim[1:4], "code": code, "offset": int(get("f", 108)[0]) or DATA_AT, "slope": slope or 1.0, "inter": inter}
    qform, sform = get("h", 252, 2)
    if sform > 0:
        affine = np.vstack([np.array(get("f", 280, 12)).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        b, c, d, *shift = get("f", 256, 6)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array(
            [
                [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)],
                [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
                [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
            ]
        )
        affine = np.eye(4)
        affine[:3, :3] = turn * np.array([size[0], size[1], size[2] * (-1 if pixdim[0] < 0 else 1)])
        affine[:3, 3] = shift
    else:
        affine = np.diag([*size, 1.0])
    return out | {"affine": affine}


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Files named .nii or .nii.gz in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower("path").rlike(r"\.nii(\.gz)?$")).select(F.element_at(F.split("path", "/"), -1).alias("volume_id"), "content")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """Grid, type, affine and the header's bytes of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [header(decompress(c)) for c in b["content"]]
            yield pd.DataFrame(
                {
                    "volume_id": b["volume_id"], "nx": [h["dims"][0] for h in found], "ny": [h["dims"][1] for h in found],
                    "nz": [h["dims"][2] for h in found], "datatype": [h["code"] for h in found], "affine": [h["affine"].tolist() for h in found],
                    "header": [decompress(c)[:DATA_AT] for c in b["content"]],
                }
            )

    return _files(spark, path).mapInPandas(run, META)


def read_voxels(spark: SparkSession, path: str, scaled: bool = False, nonzero: bool = False) -> DataFrame:
    """One row a voxel; with ``scaled`` the header's slope and intercept are applied, with ``nonzero`` zeros are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["volume_id"], b["content"], strict=True):
                raw = decompress(content)
                h = header(raw)
                nx, ny, nz = h["dims"]
                if len(raw) < h["offset"] + nx * ny * nz * np.dtype(DTYPES[h["code"]]).itemsize:
                    raise ValueError(f"{name} is shorter than its grid")
                data = np.frombuffer(raw, h["order"] + DTYPES[h["code"]], nx * ny * nz, h["offset"])
                for a in range(0, len(data), 1 << 18):
                    v = data[a : a + (1 << 18)].astype(float)
                    v = v * h["slope"] + h["inter"] if scaled else v
                    vid = np.arange(a, a + len(v))
                    keep = v != 0 if nonzero else slice(None)
                    vid, v = vid[keep], v[keep]
                    yield pd.DataFrame({"volume_id": name, "vid": vid, "x": vid % nx, "y": vid // nx % ny, "z": vid // (nx * ny), "value": v})

    return _files(spark, path).mapInPandas(run, VOXELS)


def encode(data: np.ndarray, affine=None, labels: bool = False, source: bytes | None = None, scale: tuple[float, float] = (1.0, 0.0)) -> bytes:
    """A NIfTI-1 file of a 3-D array (x, y, z): float32, or unsigned 8 or 16 bit labels with cal_max of at least 1.

    With the header of a ``source`` volume of the same grid all of it is kept (spacing, orientation, descriptions) but for type, scaling, range and extensions.
    ``scale`` is the slope and intercept that readers who scale apply to the stored values. Else sform is set, qform is not; without an affine the spacing is 1 and the grid runs from -n / 2.
    """
    if labels:
        data = data.astype("<u1" if data.max(initial=0) < 256 else "<u2")
        low, high = 0.0, float(max(1, data.max(initial=0)))
    else:
        data = data.astype("<f4")
        low, high = float(data.min(initial=0)), float(data.max(initial=0))
    if source is not None:
        h = header(source)
        if tuple(h["dims"]) != data.shape:
            raise ValueError(f"the source has a grid of {tuple(h['dims'])}, not {data.shape}")
        out, order = bytearray(source[:HEADER] + b"\0" * (DATA_AT - HEADER)), h["order"]
        data = data.astype(data.dtype.newbyteorder(order))
        struct.pack_into(f"{order}8h", out, 40, 3, *data.shape, 1, 1, 1, 1)
        struct.pack_into(f"{order}2h", out, 70, {"u1": 2, "u2": 512, "f4": 16}[data.dtype.str[1:]], data.dtype.itemsize * 8)
        struct.pack_into(f"{order}3f", out, 108, DATA_AT, *scale)
        struct.pack_into(f"{order}2f", out, 124, high, low)
        out[344:348] = b"n+1\0"
        return bytes(out) + data.tobytes(order="F")
    if affine is None:
        affine = np.eye(4)
        affine[:3, 3] = [-n / 2 for n in data.shape]
    affine = np.asarray(affine, float)
    code = {"|u1": 2, "<u2": 512, "<f4": 16}[data.dtype.str]
    out = bytearray(DATA_AT)
    struct.pack_into("<i", out, 0, HEADER)
    struct.pack_into("<8h", out, 40, 3, *data.shape, 1, 1, 1, 1)
    struct.pack_into("<2h", out, 70, code, data.dtype.itemsize * 8)
    struct.pack_into("<8f", out, 76, 1.0, *np.linalg.norm(affine[:3, :3], axis=0), 0, 0, 0, 0)
    struct.pack_into("<3f", out, 108, DATA_AT, *scale)
    struct.pack_into("<B", out, 123, 2)
    struct.pack_into("<2f", out, 124, high, low)
    struct.pack_into("<2h", out, 252, 0, 1)
    struct.pack_into("<12f", out, 280, *affine[:3].ravel())
    out[344:348] = b"n+1\0"
    return bytes(out) + data.tobytes(order="F")


def to_files(volume: DataFrame, dims, affine=None, labels: bool = False, compress: bool = True, source: bytes | None = None, scale: tuple[float, float] = (1.0, 0.0)) -> DataFrame:
    """volume_id, content: one file of bytes for each volume, with a source volume's header where that is given."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        data = np.zeros(dims)
        data[rows["x"], rows["y"], rows["z"]] = rows["value"]
        raw = encode(data, affine, labels, source, scale)
        return pd.DataFrame({"volume_id": [rows["volume_id"].iloc[0]], "content": [gzip.compress(raw, mtime=0) if compress else raw]})

    return volume.select("volume_id", "x", "y", "z", "value").groupBy("volume_id").applyInPandas(run, "volume_id string, content binary")


def write_files(files: DataFrame, folder: str, suffix: str = ".nii.gz") -> int:
    """Writes the contents into a folder of any store that pyarrow opens; returns how many.

    A task writes under a name of its own attempt and moves the whole file to its final name, so a lost or repeated task leaves none that is torn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else f"file://{folder}")
        store.create_dir(path, recursive=True)
        for b in batches:
            for name, content in zip(b["volume_id"], b["content"], strict=True):
                part = f"{path}/.{name}-{TaskContext.get().taskAttemptId()}.part"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(bytes(content))
                store.move(part, f"{path}/{name}{suffix}")
            yield b[["volume_id"]]

    return files.select("volume_id", "content").mapInPandas(run, "volume_id string").count()
