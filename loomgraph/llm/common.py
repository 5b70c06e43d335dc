"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` as
Parquet, so a lost executor never costs more than the running stage.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A node of more edges than this is a hub, whose edges are not sent to one task.
HUB = 1_000_000
#: A side with at most this many rows of two longs (about 5 MB) may be broadcast.
BROADCAST_ROWS = 200_000

_own_dir: dict[str, str] = {}
#: What a Python worker keeps between tasks of one operator.
scratch: dict = {}


def fresh_worker() -> None:
    """Let go of what an earlier operator's tasks have left in this Python worker.

    Workers serve many tasks, and an executor has several; freed memory goes back to
    the system where the C library can do that.
    """
    scratch.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a private temporary one only in local mode, where none need be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="loomgraph-")
        base = _own_dir[app]
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, watch: Observation | None = None, *what) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (cuts lineage).

    ``watch`` gets the aggregates ``what`` of the rows on the way.
    """
    spark = df.sparkSession
    df = df if watch is None else df.observe(watch, *what)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """A-Z to a-z; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with ``right`` broadcast when its counted rows are few, shuffled otherwise."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def smallest(df: DataFrame, by, k: int, rows: int, cols: list[str]) -> DataFrame:
    """``cols`` of the k rows (or all) with the smallest values of ``by``, a 64-bit hash of a row, among ``rows`` counted ones.

    Only the hashes below the one at which about 1.5 k rows are expected take part, so
    a partition sends its share of those and not k rows; the result is the same.
    """
    own = df.select(*cols, by.alias("__hash"))
    if rows > 2 * k:
        most = int(-(1 << 63) + min(1.0, (1.5 * k + 1000) / rows) * ((1 << 64) - 1))
        near = own.filter(F.col("__hash") <= F.lit(most))
        # a hash of few different values may fall short
        own = near if near.count() >= k else own
    return own.orderBy("__hash", *cols).limit(k).drop("__hash")


def join_by_hot_key(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int = 0, share: int = 1000, limit: int | None = None) -> DataFrame:
    """Left join on a key that few values may dominate.

    ``right`` has one row per key and ``weight``, the number of left rows with it.
    Keys with more than total/share left rows number fewer than ``share``, so they
    are broadcast; every other key is small enough for a shuffled join. A caller that
    has counted the keys may give the limit itself.
    """
    limit = total // share if limit is None else limit
    hot = right.filter(F.col(weight) > limit).withColumn("__hot", F.lit(True))
    first = left.join(F.broadcast(hot), key, "left")
    held = first.filter(F.col("__hot")).drop("__hot")
    rest = first.filter(F.col("__hot").isNull()).select(*left.columns)
    return held.unionByName(rest.join(right.filter(F.col(weight) <= limit), key, "left"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): the smallest node reachable over undirected edges.

    Alternating large-star and small-star steps; the edges stay distributed, and each
    step's edges and minima are tables in the shared folder. A hub's minimum is
    broadcast (there are at most edges / HUB of them, and their number is checked), so
    its edges stay where they are. Nulls and self loops are dropped; nodes without an
    edge have no row.
    """
    cur = materialize(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter("u is not null and v is not null and u > v").distinct(), "cc")
    for _ in range(max_rounds):
        for large in (True, False):
            both = cur.union(cur.select("v", "u")) if large else cur
            low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
            seen = Observation()
            low = materialize(low, "cc-min", seen, F.count(F.when(F.col("n") > HUB, 1)).alias("hubs"))
            hubs = seen.get["hubs"] or 0
            if 0 < hubs <= BROADCAST_ROWS:
                near = join_by_hot_key(both, low, "u", "n", limit=HUB)
            else:
                near = both.join(low, "u")
            if large:
                step = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                step = near.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                step = step.union(low.select("u", F.col("m").alias("v")))
            cur = materialize(step.distinct(), "cc")
        # done when all edges are stars: one edge for each node, none to a node that has one
        if cur.groupBy("u").count().filter("count > 1").isEmpty() and cur.join(cur.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("connected components did not converge")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return materialize(cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), "cc-out")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of equal keys in batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            if lo == hi:
                continue
            now = tuple(c[lo].item() if hasattr(c[lo], "item") else c[lo] for c in cols)
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(lo, hi - lo))
    if key is not None:
        yield key, pa.Table.from_batches(held)


class Unions:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
