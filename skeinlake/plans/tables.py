"""Tables between the steps of an iteration, kept where every executor can read them again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a task takes at most when a held table is joined.
HEAVY = 1_000_000
#: Rows of a round, and rounds, up to which what they meet is sought in the source alone.
NARROW, ROUNDS = 100_000, 12


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Where it is unset: a temporary folder on a single machine, an error on a cluster, whose machines share none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def passing(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table between steps; it is deleted when the application ends."""
    path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again. Iterations call this each round: the plan stays short, and a lost executor costs a reread only."""
    path = passing(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, dict]:
    """As settled, with aggregates over the rows (n: their number), taken while they are written: a round needs no second job to see whether it was the last."""
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in figures.items()]), name)
    return out, seen.get


@dataclass(frozen=True)
class Held:
    """A table that an iteration joins by one key each round, partitioned by it and kept on the executors."""

    df: DataFrame
    key: str
    #: (_heavy, _slices): keys of too many rows for one task, and over how many their rows are spread; None if there are none.
    heavy: DataFrame | None = None

    def meets(self, other: DataFrame, column: str) -> DataFrame:
        """Its join with other, key = column. A row of other whose key is heavy goes to each of the key's slices."""
        if self.heavy is None:
            return self.df.join(other, self.df[self.key] == other[column])
        wide = other.join(self.heavy, other[column] == F.col("_heavy"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))).drop("_heavy", "_slices")
        return self.df.join(wide, (self.df[self.key] == wide[column]) & (F.col("_slice") == F.col("_part"))).drop("_slice", "_part")

    def unpersist(self) -> None:
        self.df.unpersist()


def held_by(df: DataFrame, key: str, most: int = HEAVY) -> Held:
    """df partitioned by a key and held on the executors: it's exchanged once, and each round moves the other side only. Lost partitions are made again from what df reads. The caller unpersists it.

    A key of more than `most` rows, a hub, would be one task's each round: its rows are spread over slices. The counts are
    taken where the rows lie, without another exchange.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartition(n, key).persist(StorageLevel.MEMORY_AND_DISK)
    counts = held.groupBy(F.col(key).alias("_heavy")).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    heavy, found = measured(counts.select("_heavy", F.ceil(F.col("_n") / most).cast("int").alias("_slices")), "heavy")
    if not found["n"]:
        return Held(held, key)
    spread = df.join(heavy, df[key] == F.col("_heavy"), "left").withColumn("_slice", F.coalesce(F.pmod(F.xxhash64(*[df[c] for c in df.columns]), F.col("_slices")), F.lit(0)).cast("int")).drop("_heavy", "_slices")
    spread = spread.repartition(n, key, "_slice").persist(StorageLevel.MEMORY_AND_DISK)
    held.unpersist()
    return Held(spread, key, heavy)


@dataclass
class Sought:
    """A table that an iteration joins by one key each round, made for a round's keys alone while these are few: make(keys) has the rows of the keys (id), make(None) all. These are made and held once a round is wide, or rounds are many."""

    make: Callable[[DataFrame | None], DataFrame]
    key: str
    name: str
    held: Held | None = None
    rounds: int = 0

    def meets(self, other: DataFrame, column: str, n: int) -> DataFrame:
        """Its join with other, a settled table of n rows, key = column."""
        self.rounds += 1
        if self.held is None and (n > NARROW or self.rounds > ROUNDS):
            self.held = held_by(settled(self.make(None), self.name), self.key)
        if self.held is not None:
            return self.held.meets(other, column)
        some = self.make(other.select(F.col(column).alias("id")).distinct())
        return some.join(other, some[self.key] == other[column])

    def unpersist(self) -> None:
        if self.held is not None:
            self.held.unpersist()
