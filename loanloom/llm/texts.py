"""Helpers shared by the text operators: per-row Arrow kernels, shared tables, links to groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from loanloom.session import shared_path

#: A bit table has so many bits a key, and never more than the second number.
BITS_A_KEY, MOST_BITS = 12, 1 << 28

#: A batch kernel takes the texts of some rows (None for null) and returns one column per field.
Kernel = Callable[[list], list]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder all executors share and read again: later stages start from files
    that outlive any executor, and expensive steps run once."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(
    docs: DataFrame,
    fields: str,
    make_kernel: Callable[[], Kernel],
    text: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``row`` (a struct of the kept columns, so that no name can clash) beside new ``fields``.

    ``make_kernel`` runs once in each task; its kernel sees one Arrow batch of texts at a time.
    """
    keep = tuple(docs.columns) if keep is None else keep
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in keep]).alias("row"),
        docs[f"`{text}`"].cast("string").alias("text"),
    )
    added = _parse_datatype_string(fields)
    schema = StructType([StructField("row", packed.schema["row"].dataType), *added.fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        kernel = make_kernel()
        for batch in batches:
            for part in _slices(batch):
                columns = kernel(part.column(1).to_pylist())
                arrays = [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=names)
        pa.default_memory_pool().release_unused()  # workers outlive their tasks

    return packed.mapInArrow(run, schema)


def gather(
    docs: DataFrame, fields: str, make: Callable[[], Callable[[Iterator], Iterator[list]]]
) -> DataFrame:
    """Rows of ``fields`` that a task makes from its rows, however many.

    ``make()`` gives a function from an iterator of Arrow batches (the columns of ``docs``, the
    longest one last) to an iterator of lists of columns.
    """
    schema = StructType(_parse_datatype_string(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in schema.fields]
        cut = (part for batch in batches for part in _slices(batch))
        for columns in make()(cut):
            arrays = [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that Python strings of at most about ``most`` bytes exist at a time."""
    rows = batch.num_rows
    parts = max(1, min(rows, -(-batch.column(batch.num_columns - 1).nbytes // most)))
    step = -(-rows // parts) if rows else 1
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def _slots(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places of each key (64 bits, read as unsigned) in a table of ``bits``."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mask = np.uint64(bits - 1)
    return [(mixed >> np.uint64(s) & mask).astype(np.int64) for s in (35, 7)]


def bit_table(keys: DataFrame) -> np.ndarray | None:
    """A table of bounded size in which every key (one long column) is found, and a few others;
    None without keys.  A full table finds everything, so it only ever lets more through."""
    count = keys.count()
    if not count:
        return None
    bits = min(MOST_BITS, 1 << max(10, (count * BITS_A_KEY - 1).bit_length()))

    def emit(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate(_slots(own, bits))
            yield [at >> 6, np.left_shift(np.int64(1), at & 63)]

    # At most bits / 64 rows reach the driver.
    rows = (
        gather(keys, "word int, bit bigint", lambda: emit)
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    table = np.zeros(bits >> 6, np.int64)
    table[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return table.view(np.uint8)


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for slot in _slots(keys.view(np.uint64), len(table) * 8):
        found &= (table[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    return found


def connected(edges: DataFrame, name: str) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; the component is its smallest id.

    Alternating large-star and small-star rounds: each rewires a neighbourhood to its minimum,
    so rows never exceed the edges plus the ids, whatever the shape.  Every round is written to
    the shared folder; the last leaves nothing but stars.
    """
    current = written(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    while not _settled(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        current = written(_star(_star(both, larger_only=True), larger_only=False), name)
    return current.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(
        current.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Rewire every neighbour (or every larger one) of u to the least of u's neighbourhood."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m")
    )
    linked = pairs.join(least, "u")
    if larger_only:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()
    out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v"))
    )
    return out.where("u <> v").distinct()


def _settled(pairs: DataFrame) -> bool:
    """Whether every larger id has one edge, to an id that has none to a smaller one."""
    ends = pairs.select("u", F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(
        pairs.select(F.col("v").alias("u"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v"))
    )
    ends = ends.groupBy("u").agg(F.sum("as_u").alias("n"), F.max("as_v").alias("as_v"))
    return ends.where("n > 1 OR (n > 0 AND as_v > 0)").isEmpty()
