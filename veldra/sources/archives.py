"""Datasets from outside: arrays in .npz files, zipped or not, from a path or a URL, into Parquet."""

from __future__ import annotations

import io
import os
import posixpath
import tempfile
import urllib.request
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .catalogue import Dataset
from .tables import TableStore, drift_hash


def fetch(url: str) -> str:
    """Downloads to a temporary file on the driver and gives its path; file: URLs and paths work too."""
    if "://" not in url:
        return url
    fd, path = tempfile.mkstemp(suffix=os.path.splitext(url)[1])
    with urllib.request.urlopen(url) as src, os.fdopen(fd, "wb") as out:
        while chunk := src.read(1 << 20):
            out.write(chunk)
    return path


def members(path: str) -> dict[str, bytes]:
    """The .npz files of a zip by name without folders and suffix. Names that lead out of the archive are refused."""
    out = {}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            clean = posixpath.normpath(name)
            if clean.startswith(("..", "/")):
                raise ValueError(f"{name} leads out of the archive")
            if clean.endswith(".npz"):
                out[posixpath.basename(clean)[:-4]] = z.read(name)
    return out


def frame(spark: SparkSession, x: np.ndarray, y: np.ndarray | None = None) -> DataFrame:
    """row_id, x0.., and y from arrays on the driver."""
    x = np.atleast_2d(np.asarray(x, float))
    import pandas as pd

    pdf = pd.DataFrame(x, columns=[f"x{k}" for k in range(x.shape[1])])
    pdf.insert(0, "row_id", np.arange(len(x)))
    if y is not None:
        pdf["y"] = np.asarray(y, float)
    return spark.createDataFrame(pdf)


def read_npz(spark: SparkSession, source: str | bytes) -> DataFrame:
    """An .npz with X and perhaps y; pickled objects are never loaded."""
    with np.load(io.BytesIO(source) if isinstance(source, bytes) else source, allow_pickle=False) as f:
        return frame(spark, f["X"], f["y"] if "y" in f.files else None)


def import_archive(spark: SparkSession, store: TableStore, url: str, benchmark: str, version: str, datasets: dict[str, Dataset] | None = None) -> list[str]:
    """Every .npz of a zip into the store, under its name; known datasets are marked with their description's hash."""
    done = []
    for name, data in members(fetch(url)).items():
        d = (datasets or {}).get(name)
        store.resolve(spark, benchmark, version, name, lambda data=data: read_npz(spark, data), drift_hash(d.to_dict()) if d else "", force=True)
        done.append(name)
    return sorted(done)


def in_memory(spark: SparkSession, name: str, x: np.ndarray, y: np.ndarray | None = None, path: str | None = None, **details) -> tuple[Dataset, DataFrame]:
    """A dataset of arrays and its rows, written to path if given, so that it can be loaded again."""
    df = frame(spark, x, y)
    d = Dataset(name, num_variables=np.atleast_2d(x).shape[1], ranking="rmse" if y is not None else "bed", **details)
    if path:
        df.write.mode("overwrite").parquet(path)
        d.path = path
    return d, df
