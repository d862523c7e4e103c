"""Files made of ordered pieces: the sink of rasters, archives and reports."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

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


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that it is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


PIECES = "name string, seq long, data binary"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of an absolute local path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


@dataclass
class Written(WriterCommitMessage):
    #: (staged path, name)
    files: list[tuple[str, str]]


class PiecesWriter(DataSourceArrowWriter):
    """Tasks write files in a staging folder below the target; they move to their names when all tasks are done."""

    def __init__(self, path: str):
        self.path = path
        self.staging = f".staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = located(self.path)
        mine = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # of this attempt of the task
        files: list[tuple[str, str]] = []
        out, last = None, None
        try:
            for batch in iterator:
                names, seqs, data = (batch.column(k) for k in range(3))
                for name, seq, piece in zip(names.to_pylist(), seqs.to_pylist(), data, strict=True):
                    if last is not None and (name, seq) < last:
                        raise ValueError("Pieces have to be sorted by name and seq.")
                    if last is None or name != last[0]:
                        if out:
                            out.close()
                        store.create_dir(mine)
                        files.append((f"{mine}/{len(files)}", name))
                        out = store.open_output_stream(files[-1][0])
                    last = (name, seq)
                    out.write(piece.as_buffer())
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = located(self.path)
        for message in messages:
            for staged, name in message.files if message else []:
                if "/" in name:
                    store.create_dir(f"{root}/{name.rsplit('/', 1)[0]}")
                store.move(staged, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = located(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


class Pieces(DataSource):
    """``df.write.format("pieces").save(path)`` for (name, seq, data)."""

    @classmethod
    def name(cls) -> str:
        return "pieces"

    def writer(self, schema, overwrite: bool) -> PiecesWriter:
        return PiecesWriter(self.options["path"])


def write_pieces(pieces: DataFrame, path: str) -> None:
    """Write a file for each ``name`` below ``path``: its ``data`` in the order of ``seq``. A file of that name is replaced.

    A file is written by one task, piece by piece as the rows come, so memory holds a batch of pieces and never a file. A task that fails leaves
    nothing, and no file appears before all are complete. ``path`` is a folder in any store that pyarrow's file systems reach.
    """
    sorted_ = pieces.select("name", "seq", "data").repartition("name").sortWithinPartitions("name", "seq")
    save_sorted(sorted_, path)


def save_sorted(pieces: DataFrame, path: str) -> None:
    """The same for pieces that lie together by name and in order."""
    pieces.sparkSession.dataSource.register(Pieces)
    pieces.write.format("pieces").mode("append").save(path)
