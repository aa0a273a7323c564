"""Arrays kept in the folder that all executors share."""

from __future__ import annotations

import gc
import json
import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import SparkSession

from spoor.sources.shared import file_system, remove, shared_dir

__all__ = ["load", "load_many", "release_shuffles", "remove", "save", "save_many", "shared_dir"]


def save(path: str, values: np.ndarray) -> None:
    """Writes an array as .npy: under another name first, so a task that runs twice leaves one whole file."""
    files, place = file_system(path)
    files.create_dir(os.path.dirname(place), recursive=True)
    part = f"{place}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        np.lib.format.write_array(_Writer(out), np.ascontiguousarray(values), allow_pickle=False)
    files.move(part, place)


class _Writer:
    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)


def load(path: str) -> np.ndarray:
    """An array that :func:`save` wrote: mapped into memory where the folder is mounted, else read whole."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return np.load(where.path, mmap_mode="r")
    import io

    files, place = file_system(path)
    with files.open_input_file(place) as f:
        return np.load(io.BytesIO(f.read()))


def save_many(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes several arrays as one file, so that a worker maps one file for all of them."""
    head = json.dumps([(name, a.dtype.str, len(a)) for name, a in arrays.items()]).encode()
    parts = [np.array([len(head)], dtype="<i8").view(np.uint8), np.frombuffer(head, dtype=np.uint8)]
    parts += [np.ascontiguousarray(a).view(np.uint8) for a in arrays.values()]
    save(path, np.concatenate([x for p in parts for x in (p, np.zeros(-len(p) % 8, dtype=np.uint8))]))


def load_many(path: str) -> dict[str, np.ndarray]:
    """Views of the arrays that :func:`save_many` wrote, mapped if their file is."""
    raw = np.asarray(load(path))
    size = int(raw[:8].view("<i8")[0])
    out, at = {}, 8 + size + -size % 8
    for name, kind, n in json.loads(raw[8 : 8 + size].tobytes()):
        held = np.dtype(kind).itemsize * n
        out[name] = raw[at : at + held].view(kind)
        at += held + -held % 8
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Has the driver collect what no plan holds any longer, upon which Spark removes the shuffle files of ended jobs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
