"""Files written by tasks, and where they go."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: What this driver's operators have written and not yet dropped.
_written: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset only a local master gets a folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dir.append(tempfile.mkdtemp(prefix="langdrift-"))
    _written.append(f"{(shared or _own_dir[0]).rstrip('/')}/langdrift/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def drop_written(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Deletes what operators have written into the shared folder, through Spark's own file systems; the number of folders.

    Results are read from them, so call it when they are stored. ``since`` and ``until``: places in the order
    of writing (``written_so_far``), all by default.
    """
    jvm, n = spark._jvm, 0
    paths = _written[since:until]
    del _written[since:until]
    for name in reversed(paths):
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written_so_far() -> int:
    """A place in the order of writing."""
    return len(_written)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files of ended jobs go when the driver collects its garbage; it is made to do so."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, so that what follows reads it instead of making it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row (name, a path below ``folder``; content, text or binary) as a file of its own; their number.

    A file gets its name when it is whole, so a task that runs twice leaves whole files.
    """

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                path = f"{root}/{r['name']}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                content = r["content"].encode() if isinstance(r["content"], str) else r["content"]
                part = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(content)
                system.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.select("name", "content").mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0
