"""What the operators of this subpackage share: shared storage, file access from tasks, skew."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a folder of our own is made, which only a single-machine
    master can share; a cluster must name one.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not _own_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dir.append(tempfile.mkdtemp(prefix="langdrift-"))
    return _own_dir[0]


#: What this driver has written and not yet dropped.
_written: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    _written.append(f"{shared_dir(spark)}/langdrift/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def drop_written() -> int:
    """Deletes the tables, archives and token files that operators of this driver have written; their number.

    Results read from them, so call it when they are stored.
    """
    from pyarrow import fs

    n = 0
    while _written:
        system, path = open_fs(_written.pop())
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)
            n += 1
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns freed memory of a Python worker to the system: Spark keeps workers for later tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run):
    """A task's function over batches that gives memory back when it ends: only then are its own variables gone."""

    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """(file system, path) of ``uri``, opened where it is called."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def finite_vector(vector: str | Column, nonzero: bool) -> Column:
    """Whether an array column is a vector without null and non-finite components."""
    c = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = c.isNotNull() & (F.size(c) > 0) & ~F.coalesce(bad, F.lit(True))
    return ok & F.exists(c, lambda x: x != 0) if nonzero else ok


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def usual_length(rows: DataFrame, vector: str) -> tuple[int, int]:
    """(rows, length) of the most frequent length of an array column, the longer of equally frequent ones; (0, 0) without rows."""
    sizes = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return (sizes["count"], sizes["length"]) if sizes else (0, 0)


#: A key with more than this share of all rows is hot; there can be at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def join_small_values(rows: DataFrame, per_key: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` left join ``per_key`` (one row a key, ``count`` rows of ``rows`` each) on ``key``.

    Hot keys are broadcast: fewer than ``1 / HOT_SHARE`` keys can have more than
    that share of the rows, whatever the data. All others are shuffled, and none
    of them brings more than that share to one task.
    """
    limit = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(per_key.filter(F.col(count) > limit))
    cold = per_key.filter(F.col(count) <= limit)
    values = [c for c in per_key.columns if c != key]
    marked = rows.join(hot, key, "left")
    is_hot = F.col(count).isNotNull()
    joined_cold = marked.filter(~is_hot).drop(*values).join(cold, key, "left")
    return marked.filter(is_hot).unionByName(joined_cold)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
