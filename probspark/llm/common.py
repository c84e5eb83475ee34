"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own for each
    application in local mode, and an error on a cluster, whose machines do not see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="probspark-")
    return _OWN[context.applicationId]


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n: the fixed split into training and held-out rows (null id: fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % F.lit(n), F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, parts_per_core: int = 2) -> DataFrame:
    """Deal rows of a small table over the cores, where the number of its input files says nothing about the work per row."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism * parts_per_core))


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: whole texts of some kB each would else fill a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, rows)


def slices(texts: list, chars: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about that many characters, one text at least."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= chars:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out + [(start, len(texts))] * (start < len(texts))


#: Integer components stay within this bound, so that sums of squares of some hundred of them fit 64 bits.
MOST_COMPONENT = 2**26


def usable(vector: str) -> Column:
    """The vector is there, and so are all its components, each finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, odd), F.lit(False))


def whole_numbers(vectors, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, x as double; saturated at MOST_COMPONENT either way."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    return np.clip(np.floor(scale * x), -MOST_COMPONENT, MOST_COMPONENT).astype(np.int64)
