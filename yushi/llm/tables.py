"""Small helpers that all operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yushi.session import work_dir


_READY: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Python workers get the package with addPyFile if they can't import it; with --py-files or a path they can, and nothing is sent."""
    sc = spark.sparkContext
    if sc.applicationId in _READY:
        return

    def probe(batches):
        from importlib.util import find_spec

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([find_spec("yushi") is not None] * b.num_rows)], ["known"])

    if not spark.range(1).mapInArrow(probe, "known boolean").first().known:
        package = Path(__file__).resolve().parent.parent
        bundle = Path(tempfile.mkdtemp(prefix="yushi-code-")) / "yushi.zip"
        with zipfile.ZipFile(bundle, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(bundle))
    _READY.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder: lineage ends there, and a lost executor loses nothing."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8; a null stays None."""
    return column.cast(pa.binary()).to_pylist()


_SLICE = 8 << 20


def slices(b: pa.RecordBatch, size: int = _SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about `size` bytes, one row at least."""
    step = max(1, b.num_rows * size // max(size, b.nbytes))
    for first in range(0, b.num_rows, step):
        yield b.slice(first, step)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each Arrow batch through fn, a few megabytes at a time; empty batches are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def by_place(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """docs with columns named after their place, but for `keep`: Arrow functions over whole rows don't take names with a dot."""
    return docs.toDF(*[c if c in keep else f"column_{k}" for k, c in enumerate(docs.columns)])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)


def parts(df: DataFrame, least: int = 1) -> int:
    """Partitions for an explicit exchange: what the session has for shuffles."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed(docs: DataFrame, *ids: str) -> DataFrame:
    """The id columns (doc_id if none is named) as long, and body, the compressed text: what a shuffle of whole texts carries."""
    ids = ids or ("doc_id",)

    def run(b):
        z = zstandard.ZstdCompressor(level=1)
        body = pa.array([None if t is None else z.compress(t) for t in utf8(b.column(len(ids)))], pa.binary())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], body], [*ids, "body"])

    return arrow_map(docs.select(*[F.col(c).cast("long").alias(c) for c in ids], "text"), run, ", ".join(f"{c} long" for c in ids) + ", body binary")
