"""What several operators share: reading texts batch by batch, and sums over a spread-out order."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from appwatch.session import scratch_path

# Fixed value: white space is the space and the five control characters from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python processes, once per application.

    Without it they find the package only where it is installed or on their PYTHONPATH.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    import appwatch

    root = os.path.dirname(os.path.abspath(appwatch.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="appwatch-package-"), "appwatch.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("appwatch", os.path.relpath(path, root)))
    context.addPyFile(target)  # served by the driver; the folder is not read by anything else
    _shipped.add(context.applicationId)


# An Arrow batch lies outside the heap twice, and once more in Python: ten thousand texts are far too many.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers, by batches of 4 MB unless the session says otherwise."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(BATCH_BYTES, "4m")
    return df.mapInArrow(run, schema)


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of few rows, so that Python objects of few texts live at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


_ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
}


@functools.cache
def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    """The Arrow schema of a Spark schema, or of a plain list like ``"doc_id long, ids array<int>"``."""
    if isinstance(schema, T.StructType):
        return to_arrow_schema(schema)

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else _ARROW[name]

    return pa.schema([(name, kind(of)) for name, of in (f.split() for f in schema.split(","))])


def to_batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    target = arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in target], schema=target)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the columns called so, in any case."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone])


def field(df: DataFrame, name: str, kind: str) -> Column:
    """The column called ``name``, quoted, as ``kind``."""
    return F.col("`" + name.replace("`", "``") + "`").cast(kind)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], parts: int = 1000) -> DataFrame:
    """Left join to a side with one row per key, where any key may hold a large share of the left rows.

    Keys with more than one in ``parts`` of the left rows are fewer than ``parts``, whatever the size of
    the data; only their rows of ``right`` are broadcast. All others meet in a shuffle. Keys are not null.
    """
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    often = F.col("_rows") * parts > counts.agg(F.sum("_rows")).scalar()
    hot = stored(counts.where(often).select(*on, F.lit(True).alias("_hot")), "hot-keys")
    marked = left.join(F.broadcast(hot), on, "left")
    few = right.join(F.broadcast(hot.drop("_hot")), on, "left_semi")
    spread = marked.where("_hot").drop("_hot").join(F.broadcast(few), on, "left")
    return spread.unionByName(marked.where("_hot is null").drop("_hot").join(right, on, "left"))


def marked(df: DataFrame, key: list[Column], keys: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: false where ``key`` is certainly no row of ``keys``, which has columns of the same kinds.

    The keys are a broadcast bitmap of at most 16 MB, with 32 bits for each key as long as that lasts. Rows with wide columns
    that the bitmap rules out need not be shuffled for a join with ``keys``; what it lets pass by chance has to be joined.
    """
    bits = min(27, max(15, (32 * keys.count()).bit_length()))
    place, bucket, bitmap = (free_name(df, n) for n in ("key_place", "key_bucket", "key_bitmap"))

    def placed(columns: list[Column]) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits) + 1

    held = keys.select(placed([F.col(c) for c in keys.columns]).alias(place)).withColumn(bucket, F.bitmap_bucket_number(place))
    held = held.repartition(bucket).groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias(bitmap))
    joined = df.withColumn(place, placed(key)).join(F.broadcast(held), F.bitmap_bucket_number(place) == F.col(bucket), "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return joined.withColumn(name, hit).drop(place, bucket, bitmap)


def side_table(path: str, columns: list[str]) -> pa.Table:
    """A small table that Spark wrote to shared storage, read inside a task. Its size must have a bound of its own."""
    store, inner = fs.FileSystem.from_uri(path)
    return ds.dataset(inner, filesystem=store, format="parquet").to_table(columns)
