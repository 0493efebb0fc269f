"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from spectraloom.store import shared_folder

#: The words of a text everywhere in this package: runs of anything but space, tab and line ends.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the given names. Columns are found by position, so other
    columns whose names differ in case only, or that occur twice, do no harm."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    plain = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"_{at[old]}").alias(new) for new, old in columns.items()))


class Tables:
    """Intermediate results as Parquet in the shared folder: they cut lineage, survive lost
    executors and are read more than once without being computed again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow_schema(ddl: str) -> tuple[StructType, pa.Schema]:
    kind = _parse_datatype_string(ddl)
    return kind, pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in kind.fields])


def map_batches(df: DataFrame, ddl: str, setup: Callable, rows: int = 512) -> DataFrame:
    """``setup()`` runs once a task and returns ``fn(list of columns) -> list of columns``, which
    gets at most ``rows`` rows at a time, so long texts meet in small groups only."""
    kind, schema = arrow_schema(ddl)

    def run(batches):
        fn = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn([c.to_pylist() for c in part.columns])
                if out and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return df.mapInArrow(run, kind)


def map_rows(df: DataFrame, ddl: str, setup: Callable, rows: int = 512) -> DataFrame:
    """As ``map_batches``; ``setup()`` returns ``fn(*row) -> tuple``, one row out for each row in."""

    def begin():
        fn = setup()
        return lambda columns: list(zip(*map(fn, *columns)))

    return map_batches(df, ddl, begin, rows)
