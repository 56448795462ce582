"""What several training-data operators share: scratch tables, whole-group batching and connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import settled as written

#: What else a worker process lets go of when a task of it ends.
AT_TASK_END: list[Callable[[], None]] = []


def give_back() -> None:
    """Returns what this worker process has freed to the system, as others of its executor may need it."""
    for step in AT_TASK_END:
        step()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``df.mapInPandas(run, schema)`` whose tasks give their memory back when they end; workers serve many tasks, one by one."""

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(frames)
        finally:
            give_back()

    return df.mapInPandas(whole, schema)



def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_groups(batches: Iterator[pd.DataFrame], key: str, target: int, weigh: Callable[[pd.DataFrame], int] = len) -> Iterator[pd.DataFrame]:
    """Frames of about ``target`` weight that hold only whole groups of ``key``, from rows sorted by it."""
    held: list[pd.DataFrame] = []
    weight = 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        weight += weigh(pdf)
        if weight < target:
            continue
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else pdf
        keys = pdf[key].to_numpy()
        before = np.flatnonzero(keys != keys[-1])
        if before.size:
            yield pdf.iloc[: before[-1] + 1].reset_index(drop=True)
            pdf = pdf.iloc[before[-1] + 1 :].reset_index(drop=True)
        held, weight = [pdf], weigh(pdf)
    if held:
        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]


def bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(sorted_keys)
    if not n:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads the bits of an unsigned integer over all of them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternates large-star and small-star steps until nothing changes, each step's edges written to the shared folder. Hot nodes meet
    their minimum in partially aggregated groups and their neighbours in plain joins, which adaptive execution can split.
    """
    now = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct())
    before = None
    for _ in range(rounds):
        # large star: every node sends its larger neighbours to the smallest node around it
        around = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(now.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = around.where("y > x").join(least, "x").select(F.col("m").alias("lo"), F.col("y").alias("hi"))
        large = written(large.where("lo < hi").distinct())
        # small star: every node links its smaller neighbours and itself to the smallest of them
        least = large.groupBy(F.col("hi").alias("x")).agg(F.min("lo").alias("m"))
        small = large.join(least.withColumnRenamed("x", "hi"), "hi").select("lo", "hi", "m")
        now = small.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").unionAll(least.select(F.col("m").alias("lo"), F.col("x").alias("hi")))
        now = written(now.distinct())
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        state = (seen["n"], seen["s"])
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()


def sha_hex(column: Column) -> Column:
    return F.sha2(F.encode(column, "UTF-8"), 256)
