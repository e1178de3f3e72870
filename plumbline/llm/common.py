"""Small helpers that several operators share."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

import plumbline
from plumbline.session import scratch_path

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run; done once per application."""
    context, root = spark.sparkContext, Path(plumbline.__file__).parent
    if context.applicationId in _SHIPPED or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, str(file.relative_to(root.parent)))
    uri = f"{scratch_path(spark, 'plumbline')}.zip"
    path = context._jvm.org.apache.hadoop.fs.Path(uri)
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(uri)
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def add_columns(
    df: DataFrame,
    fields: list[StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
) -> DataFrame:
    """``df`` with columns computed batch by batch; columns of those names are replaced."""
    ship(df.sparkSession)
    names = [f.name for f in fields]
    kept = [c for c in df.columns if c not in names]
    # ``compute`` sees every column of ``df``; only ``kept`` ones are handed back.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in kept] + compute(batch)
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    schema = StructType([df.schema[c] for c in kept] + fields)
    return df.mapInArrow(run, schema)
