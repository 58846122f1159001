"""Files in and out, and the named views."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from repaylens.functions.columns import money_as_double
from repaylens.schemas import SCHEMAS
from repaylens.session import shared_path, spent_shuffles_removed

Tables = Mapping[str, DataFrame]


class LazyTables(Mapping):
    """Tables that are only planned when an analysis asks for them."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file or folder with a header line, read with a stated schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_raw_tables(spark: SparkSession, folder: str, pattern: str = "{name}.csv") -> Tables:
    """The six source tables from CSV; ``pattern`` gives the file name of a table."""
    base = folder.rstrip("/")
    return {
        name: read_csv(spark, f"{base}/{pattern.format(name=name)}", schema)
        for name, schema in SCHEMAS.items()
    }


def read_parquet_tables(spark: SparkSession, folder: str) -> Tables:
    """The six source tables from ``<folder>/<table>.parquet``."""
    base = folder.rstrip("/")
    return {name: spark.read.parquet(f"{base}/{name}.parquet") for name in SCHEMAS}


def read_catalog_tables(spark: SparkSession, database: str | None = None) -> Tables:
    """The six source tables from the session catalog."""
    prefix = f"{database}." if database else ""
    return {name: spark.table(prefix + name) for name in SCHEMAS}


def export_csv(
    df: DataFrame, path: str, order_by: Sequence[str] = (), files: int | None = None, mode: str = "error"
) -> None:
    """Write a result as CSV with a header line. ``mode`` says what to do if ``path`` exists.

    ``order_by`` sorts over all files (file order is row order). ``files`` is for
    report-sized results only: ``files=1`` gives a single file to hand over.
    """
    out = money_as_double(df)
    if order_by:
        out = out.orderBy(*order_by)
    if files is not None:
        out = out.coalesce(files)
    out.write.mode(mode).option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write a result as Parquet, by partition columns of few values where given."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Make every frame queryable by name in Spark SQL."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def stored(df: DataFrame) -> DataFrame:
    """Store a frame that several queries read as Parquet in the shared folder.

    The copy lives outside the executors, so losing one does not recompute it, and each
    query reads the columns it uses only.
    """
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, and the path of the copy for those who remove it."""
    spark = df.sparkSession
    path = shared_path(spark)
    with spent_shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
