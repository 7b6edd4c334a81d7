"""Intermediate tables, and joins that stay balanced.

Loops cut their lineage by writing each round as a parquet table below the cluster's
checkpoint folder and reading it back. A written table survives the loss of any executor,
keeps column pruning, and gives the planner true sizes for its join choice.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows a side may have before it is no longer broadcast (see ``attach``).
BROADCAST_ROWS = 200_000
# Keys that occur in a large table and still have their rows broadcast: where a table has many rows and few keys.
BROADCAST_KEYS = 500_000
# Rows of one join key that a single task should take at most; a key with more is salted.
HOT_ROWS = 5_000_000
# Plan size per core below which CPU-heavy scans are spread over all cores (see ``spread``).
SMALL_PER_CORE = 32 * 1024 * 1024

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` where the session names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    app = sc.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="linkloom-")
    return _local_roots[app]


def _new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, also: str | None) -> tuple[int, int]:
    seen = Observation()
    extra = F.count_if(F.col(also)) if also else F.count(F.lit(1))
    df.observe(seen, F.count(F.lit(1)).alias("rows"), extra.alias("also")).write.parquet(path)
    return seen.get["rows"], seen.get["also"]


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` as a table; return the reader over it and its row count.

    The count is observed in the writing stage itself, so a loop needs no second job per round.
    """
    path = _new_path(df.sparkSession, label)
    rows, _ = _write(df, path, None)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._table = path
    return written, rows


def materialize(df: DataFrame, label: str) -> DataFrame:
    return write_table(df, label)[0]


def numbered_table(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table, with columns _file and _row that name each of its rows: the same at every reading. What
    ``write_table`` has returned is not written again."""
    held = df if "_table" in df.__dict__ else materialize(df, label)
    return held.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``write_table`` that nothing reads any more, so that a long job holds only what it still needs."""
    for df in tables:
        path = df.__dict__.pop("_table", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Rounds:
    """The tables of a loop: written one by one, read one by one or all as a single scan."""

    def __init__(self, label: str):
        self.label, self.paths = label, []

    def add(self, df: DataFrame, also: str | None = None) -> tuple[DataFrame, int]:
        """Write a round. The count is that of all rows, or of those where column ``also`` is true."""
        self.spark, self.schema = df.sparkSession, df.schema
        self.paths.append(_new_path(self.spark, self.label))
        rows, marked = _write(df, self.paths[-1], also)
        return self.spark.read.schema(self.schema).parquet(self.paths[-1]), marked if also else rows

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


class Shelves:
    """A table that is written piece by piece and read shelf by shelf: the rows of one value of column ``by``.

    A loop that hands rows on to later rounds writes each once and reads each once.
    """

    def __init__(self, spark: SparkSession, label: str, by: str):
        self.spark, self.by, self.path, self.schema = spark, by, _new_path(spark, label), None

    def put(self, df: DataFrame) -> None:
        self.schema = df.drop(self.by).schema
        df.write.mode("append").partitionBy(self.by).parquet(self.path)

    def _read(self, at: str) -> DataFrame:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not held.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(held):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(at)

    def take(self, value) -> DataFrame:
        return self._read(f"{self.path}/{self.by}={value}")

    def all(self) -> DataFrame:
        return self._read(self.path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-heavy work on a small input.

    Parquet splits are sized for reading. Where the whole input is smaller than a split per
    core, it would end in a few tasks; then, and only then, it is shuffled round robin.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SMALL_PER_CORE else df


# --- balanced joins ------------------------------------------------------------------------

class HotKeys:
    """Join keys that hold more than ``HOT_ROWS`` rows, with a number of salts each: ``counted`` has keys and ``_n``."""

    def __init__(self, counted: DataFrame, on: list[str]):
        self.on = on
        self.keys, self.count = write_table(counted.where(F.col("_n") > HOT_ROWS).select(
            *on, F.ceil(F.col("_n") / HOT_ROWS).alias("_salts")), "hot")

    def _marked(self, df: DataFrame) -> DataFrame:
        # At most one key per HOT_ROWS rows of the table, so the list is small; checked all the same.
        keys = F.broadcast(self.keys) if self.count <= BROADCAST_ROWS else self.keys
        return df.join(keys, self.on, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    def salted(self, df: DataFrame) -> DataFrame:
        """Rows of a hot key dealt out over its salts by a hash of the row."""
        row = [F.col(c) for c in df.columns]
        return self._marked(df).withColumn("_salt", F.pmod(F.xxhash64(*row), F.col("_salts"))).drop("_salts")

    def copied(self, df: DataFrame) -> DataFrame:
        """Rows of a hot key once per salt."""
        salts = F.sequence(F.lit(0).cast("bigint"), F.col("_salts").cast("bigint") - 1)
        return self._marked(df).withColumn("_salt", F.explode(salts)).drop("_salts")


def hot_keys(table: DataFrame, on: list[str], rows: int | None = None) -> HotKeys | None:
    """Hot keys of a stored table; None without a job when the table itself is small."""
    if rows is None:
        rows = table.limit(HOT_ROWS + 1).count()
    if rows <= HOT_ROWS:
        return None
    hot = HotKeys(table.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), on)
    return hot if hot.count else None


def balanced_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                  hot: HotKeys | None = None) -> DataFrame:
    """Join in which the hot keys of ``big`` are spread over several tasks.

    Every row of ``big`` meets every row of ``small`` with its key, once: the result is that of
    the plain join. ``how`` may be inner, left, left_semi or left_anti.
    """
    if hot is None:
        return big.join(small, on, how)
    return hot.salted(big).join(hot.copied(small), [*on, "_salt"], how).drop("_salt")


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int | None = None,
           source: DataFrame | None = None) -> DataFrame:
    """Join facts by key onto a table that may be skewed on that key.

    ``small`` is counted first (or ``rows`` tells its size). Within ``BROADCAST_ROWS`` it is
    broadcast, so the big side does not move, and so it is where the big side has few keys, with the rows of these;
    beyond that both are shuffled, hot keys salted. ``source`` is a stored table
    with the keys of ``big``, where that is a join itself and would be worked out once more to count them.
    """
    if rows is None:
        rows = small.limit(BROADCAST_ROWS + 1).count()
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    keys = (big if source is None else source).select(*on)
    if keys.limit(HOT_ROWS + 1).count() <= HOT_ROWS:
        return big.join(small, on, how)
    counted, n = write_table(keys.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")), "keys")
    if n <= BROADCAST_KEYS:
        few, n = write_table(small.join(F.broadcast(counted.select(*on)), on, "left_semi"), "few")
        if n <= BROADCAST_KEYS:
            return big.join(F.broadcast(few), on, how)
    hot = HotKeys(counted, on)
    return balanced_join(big, small, on, how, hot if hot.count else None)


__all__ = ["BROADCAST_ROWS", "HOT_ROWS", "HotKeys", "Rounds", "Shelves", "attach", "balanced_join", "discard", "hot_keys",
           "materialize", "numbered_table", "scratch_root", "spread", "write_table"]
