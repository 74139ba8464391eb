"""What the corpus operators share: scratch tables, tables of a data folder, Arrow maps that carry columns along."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.scratch import materialize, scratch_path  # noqa: F401  the corpus operators take them from here

#: Rows of an Arrow batch. Spark's 10000 documents would be held several times over, in the JVM and in Python.
_ROWS, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Bytes of text that a Python task holds at once besides the Arrow batch itself.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(name: str, *taken: list[str]) -> str:
    """name, with as many underscores before it as make it differ (whatever the case) from all columns that a table has."""
    used = {c.lower() for columns in taken for c in columns}
    while name.lower() in used:
        name = "_" + name
    return name


#: What the operator that this Python worker runs keeps between batches.
_STATE: dict = {}


def worker_state(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What `make` makes, kept in this process until another owner asks, or the same with another key (an object of its own, or a string).

    So a worker that serves several operators holds the state of one.
    """
    held = _STATE.get("key")
    if _STATE.get("owner") != owner or not (held is key or isinstance(key, str) and held == key):
        _STATE.clear()
        _STATE.update(owner=owner, key=key, value=make())
    return _STATE["value"]


def map_batches(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows, for every corpus operator alike. The session's setting is read when the plan runs, so it is set here unless the session has its own."""
    settings = df.sparkSession.conf
    if settings.get(_ROWS) == "10000":  # Spark's default
        settings.set(_ROWS, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def append_columns(
    df: DataFrame, keep: list[str], new: T.StructType, fn: Callable[[pa.RecordBatch], list[pa.Array]]
) -> DataFrame:
    """Columns `keep` of df, and the columns `new` that fn makes of each Arrow batch (in slices of bounded bytes).

    fn sees every column of df by name, gives one array for each new field, and never sees more than SLICE_BYTES of data in
    more than one row. A new column whose name a kept one has is refused.
    """
    if twice := {k.lower() for k in keep} & {f.name.lower() for f in new.fields}:
        raise ValueError(f"columns {sorted(twice)} are both kept and made: rename them first")
    schema = T.StructType([df.schema[k] for k in keep] + list(new.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = fn(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(k)) for k in keep] + made, names=schema.names)

    return map_batches(df, run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes; a longer row is alone."""
    if batch.num_rows <= 1 or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
