"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that Python works on at once. Texts can be long, so they are few; Spark itself bounds a batch by its bytes.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, one is made if all runs on this machine; a cluster raises."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underlines before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salted(big: DataFrame, small: DataFrame, on: list[str], by: str | list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """A join of ``big`` with one row of ``small`` for each ``on``, whose rows are repeated so that a hot key is dealt to ``salts`` tasks
    by the hash of ``by``."""
    name = free_name(big, "_salt")
    deal = F.pmod(F.xxhash64(F.lit(11), *([by] if isinstance(by, str) else by)), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return big.withColumn(name, deal).join(small.withColumn(name, every), [*on, name], how).drop(name)


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col(f"`{name.replace('`', '``')}`")


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most ``rows`` at once."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow``, which alone would read a dot in a column's name as a field of a struct."""
    given = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(given))]).mapInArrow(lambda batches: fn(b.rename_columns(given) for b in batches), schema)


def with_columns(df: DataFrame, schema: str | T.StructType, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """``df`` with the columns of ``schema``, which ``fn`` computes from some rows at a time.

    A column of ``df`` that has the name of a new one, in any case, is replaced.
    """
    new = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = [f.name for f in new.fields]
    lower = {n.lower() for n in names}
    kept = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in lower]
    fields = [df.schema.fields[i] for i in kept]
    out = T.StructType([*fields, *new.fields])
    labels = [f.name for f in out.fields]

    def run(batches):
        for batch in small_batches(batches):
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [made[n] for n in names], labels)

    return map_batches(df, run, out)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [t or "" for t in column(batch, name).to_pylist()]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """``df`` written as a Parquet table in the shared folder and read again (for wide rows, which it stores compressed), and its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``write_table`` wrote, once nothing reads it any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
