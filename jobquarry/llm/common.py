"""Shared pieces: written tables that cut lineage, block grids for large groups, labels of linked rows, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract here defines it: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Added columns start with this, so that columns of the input do not clash with them.
PREFIX = "__jq_"

#: Bits that a filter of keys has for each of them, and at most (8 MB).
MARKS, MOST_MARKS = 32, 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the session is local is a
    temporary folder made; on a cluster without the setting this raises, because a machine-local folder
    would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="jobquarry-")
        spark.sparkContext.setCheckpointDir(base)
    return base


class Workspace:
    """Written tables of one operator call, under one folder of ``shared_dir``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/jobquarry/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, observation: Observation | None = None) -> DataFrame:
        """Write ``df`` as Parquet and return the reread table; the plan above it starts there."""
        return self.spark.read.schema(df.schema).parquet(self.write_path(df, observation))

    def write_path(self, df: DataFrame, observation: Observation | None = None) -> str:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        if observation is not None:
            df = observation_of(df, observation)
        df.write.parquet(path)
        return path

    def read(self, path: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, path: str) -> None:
        """Delete a written table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def observation_of(df: DataFrame, observation: Observation) -> DataFrame:
    """Count the rows and combine their hashes while they pass, without another scan."""
    return df.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns])), F.lit(0)).alias("mix"),
    )


def block_grid(rows: DataFrame, shard: list[str], uid: str, block_rows: int, wide_rows: int = 0, few: int = 0) -> DataFrame:
    """Split every shard into blocks and send each row to the pairs of blocks that hold it.

    Adds ``blk`` (the row's block), ``bi`` and ``bj`` (``bi <= bj``). Within the group (shard, bi, bj) the
    rows of block ``bi`` meet those of ``bj``, so each pair of rows of a shard meets exactly once, and no
    task holds more than about ``2 * block_rows`` rows of even the largest shard. A row is copied once for
    each block of its own shard; with ``wide_rows``, a shard of more than ``few`` blocks gets blocks of up to so
    many rows instead of more copies.
    """
    blocks = lambda n: F.ceil(F.count(F.lit(1)) / F.lit(float(n)))
    nb = (F.greatest(F.least(blocks(block_rows), F.lit(few)), blocks(wide_rows)) if wide_rows else blocks(block_rows)).cast("int").alias("nb")
    sizes = rows.groupBy(*[F.col(c).alias(f"{PREFIX}{c}") for c in shard]).agg(nb)
    joined = rows.join(sizes, [F.col(c) == F.col(f"{PREFIX}{c}") for c in shard])
    return (
        joined.withColumn("blk", F.pmod(F.xxhash64(uid), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("bi", F.least("blk", "other"))
        .withColumn("bj", F.greatest("blk", "other"))
        .drop("nb", "other", *[f"{PREFIX}{c}" for c in shard])
    )


def among(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test of hashes for whether they may be among those of the written table ``keys``: true for all that are, and for about
    one of ``MARKS`` others (for more of them, if all the marks would take over ``MOST_MARKS`` bits). It says which rows an exact
    join has to move. Only the hash of a row leaves the JVM."""
    bits = min(MOST_MARKS, 1 << max(10, (MARKS * keys.count() - 1).bit_length()))
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    word = F.expr(f"bit_or(shiftleft(1L, CAST(`{column}` & 63 AS INT)))").alias("word")
    found = keys.groupBy(F.shiftright(slot, 6).alias("at")).agg(word).toArrow()
    words = np.zeros(bits >> 6, np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        at = key.to_numpy() & (bits - 1)
        return pd.Series((words[at >> 6] >> (at & 63)) & 1 == 1)

    return test


class Labels:
    """Labels of positions, contracted by arrays of linked pairs; a label is a position with the same label."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.of[i], self.of[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := self.of[self.of], self.of):
                self.of = jumped


def connected_components(ws: Workspace, edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph, as (``id`` long, ``root`` long: the smallest id reached).

    Alternates large-star and small-star steps, each a few aggregations and joins, until a pass changes
    nothing; the number of passes grows with the logarithm of the longest chain. Every pass is written, so
    a lost executor costs one pass, and its predecessor is deleted. Edges never reach the driver. Self
    loops, null ends and repeated edges are ignored; ids without an edge to another id are not returned.
    """
    first = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .where("u <> v")
        .distinct()
    )
    schema = first.schema
    seen = Observation()
    path = ws.write_path(first, seen)
    before = seen.get
    while before["rows"]:
        e = ws.read(path, schema)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        seen = Observation()
        after_path = ws.write_path(small.select("u", "v"), seen)
        ws.drop(path)
        path, now = after_path, seen.get
        if now == before:
            break
        before = now
    e = ws.read(path, schema)
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
