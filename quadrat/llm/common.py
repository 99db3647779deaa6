"""Small helpers that every operator of the subpackage uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: x20 and x09 to x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; Spark opens the path, whatever its file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A to Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def digest(c: Column) -> Column:
    """Lower-case hex sha256 of a string."""
    return F.sha2(c, 256)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master may
    go without: the session then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if known := sc._jsc.sc().getCheckpointDir().getOrElse(None) if _has_dir(sc) else None:
        return str(known).rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadrat-"))
    return shared_dir(spark)


def _has_dir(sc) -> bool:
    return sc._jsc.sc().getCheckpointDir().isDefined()


#: Folders that ``stored`` wrote and nobody has released.
_written: list[str] = []


#: Spark deletes the shuffle files of a query when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again.

    It cuts the lineage, so a lost executor costs a reread, not a recomputation.
    The folder stays until ``release``: a result that reads it may be lazy.
    With ``clean`` the shuffle files that it took are gone then, not only when
    the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, None)
    if clean:
        spark.conf.set(CLEAN, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> tuple[str, ...]:
    """The folders that ``stored`` wrote and that are there."""
    return tuple(_written)


def release(spark: SparkSession, keep: DataFrame | None = None, before: Sequence[str] = ()) -> None:
    """Delete what ``stored`` has written, but for the table that ``keep`` reads and what was written ``before``.

    For the end of a job, or when a result that needed the tables is itself
    written: results that still read them can't be computed any more.
    """
    kept = keep.inputFiles() if keep is not None else []
    for path in set(_written).difference(before):
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in kept):
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
            _written.remove(path)


#: A key of more rows than this, or than one of SHARES of all rows, is split.
HOT, SHARES = 2_000, 2_000


def hot_parts(counts: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """key, parts: in how many parts the rows of a hot key are worked on; other keys aren't listed.

    ``counts``: a row for each key with its rows; ``total``: their sum, if known.  A hot key has more than HOT
    rows and more than one of SHARES of all, so there are fewer than SHARES hot
    keys whatever the table: the list is safe to broadcast.
    """
    if total is None:
        limit = counts.agg(F.greatest(F.lit(HOT), F.ceil(F.sum(n) / SHARES)).alias("limit"))
        hot = counts.select(key, n).crossJoin(F.broadcast(limit))  # one row
    else:
        hot = counts.select(key, n, F.lit(max(HOT, -(-total // SHARES))).alias("limit"))
    hot = hot.where(F.col(n) > F.col("limit"))
    return hot.select(key, F.ceil(F.col(n) / F.col("limit")).cast("int").alias("parts"))


def slices(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
