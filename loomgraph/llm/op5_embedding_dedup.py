"""Near-duplicate embeddings by an epsilon grid order join.

Cosine c of unit vectors is distance sqrt(2 - 2c), so near pairs are those within
epsilon. Equal vectors are one class with a weight, so copies are never compared
with each other. Classes are rotated to principal dimensions (fitted to a bounded
sample; a rotation keeps distances, so the fit only decides the speed) and sorted by
the cells of a grid of epsilon width on the leading GRID dimensions: bounds taken
from the sample range-partition the sequence, each range is sorted and cut in order
into blocks. Pairs of blocks come from a recursive join of the sequence of blocks
with itself on their boxes, made by tasks and kept as a table. Within a pair of
blocks the recursion goes on over halves down to LEAF rows: parts further apart than
epsilon are skipped, parts that are wholly within it are linked without comparing.
The rest is compared: a lower bound of the distance on the NARROW leading dimensions
first, then the cosine in double precision. A pair of blocks yields link counts and a
spanning forest, so the output is linear in the rows read, not in the links.

Where the leading dimensions tell little (a flat spectrum) no box can be skipped and
the comparisons grow with the square of the classes, as in any exact join; blocks
then grow with the table (``block_rows``), so that each class goes to about
MOST_BLOCKS blocks and not to ever more of them.

The driver and each task of the pair join hold a box of 2 x GRID numbers for each
block, one in BLOCK rows or more; the driver also holds the sample (SAMPLE rows).

Null, empty or zero vectors and vectors with null or non-finite components link with
nothing, nor does a row with a null id; each gets its row. Each row is a vector of its
own: rows that repeat an id and vector are links of each other, rows that repeat an id
with another vector are judged apart. Vectors of different dimensions aren't linked;
each dimension has a join of its own. Components are scaled before they are squared.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Unions, connected_components, join_by_hot_key, materialize, runs, sized_join, smallest

COSINE, GRID, BLOCK, LEAF, SAMPLE, MOST_INTERVALS, NARROW = 0.95, 8, 4096, 512, 20_000, 2048, 24
#: Blocks grow from BLOCK rows to LARGEST rows so that there are about MOST_BLOCKS of them.
MOST_BLOCKS, LARGEST = 64, 32_768
#: What rounding may add to a distance; parts this near to the limit are compared.
SLACK = 1e-6
#: The same for squared distances in single precision.
NARROW_SLACK = 1e-4


def block_rows(n: int, block: int = BLOCK) -> int:
    """Rows of a block in a join of n classes."""
    return max(block, min(LARGEST, -(-n // MOST_BLOCKS)))


def fit_rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: principal directions of the sample, leading first."""
    dim = sample.shape[1]
    if len(sample) < 2:
        return np.eye(dim)
    _, vectors = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))
    return np.ascontiguousarray(vectors[:, ::-1])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def grid_cells(rotated: np.ndarray, eps: float) -> np.ndarray:
    """Cells of the leading dimensions, GRID columns whatever the dimension."""
    out = np.zeros((len(rotated), GRID), np.int64)
    lead = np.floor(rotated[:, :GRID] / eps)
    out[:, : lead.shape[1]] = lead
    return out


def box_gap(a, b) -> float:
    """Least distance between points of two boxes (low corner, high corner)."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return math.sqrt(float(gap @ gap))


def halves(s: int, e: int, least: int = 1) -> list[tuple[int, int]]:
    return [(s, e)] if e - s <= least else [(s, (s + e) // 2), ((s + e) // 2, e)]


class Boxes:
    """Boxes of the intervals of a sequence, each computed once."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi, self.known = lo, hi, {}

    def of(self, s: int, e: int):
        if (s, e) not in self.known:
            self.known[s, e] = (self.lo[s:e].min(0), self.hi[s:e].max(0))
        return self.known[s, e]


def block_partners(boxes: Boxes, a: int, eps: float) -> list[int]:
    """The blocks b >= a of the sequence that are not further from block a than eps."""
    out: list[int] = []
    own = boxes.of(a, a + 1)

    def join(s, e):
        if e <= a or box_gap(own, boxes.of(s, e)) > eps + SLACK:
            return
        if e - s == 1:
            out.append(s)
            return
        for part in halves(s, e):
            join(*part)

    join(0, len(boxes.lo))
    return out


class Sequence:
    """Unit vectors in grid order, with a box and a ball for the intervals that a join visits."""

    def __init__(self, x: np.ndarray, rot: np.ndarray):
        self.x, self.rot, self.known = x, rot, {}
        self.narrow = np.ascontiguousarray(rot[:, :NARROW], dtype=np.float32)
        self.square = np.einsum("ij,ij->i", self.narrow, self.narrow)

    def of(self, s: int, e: int):
        """((low, high corner), centre, radius)."""
        if (s, e) not in self.known:
            r = self.rot[s:e]
            centre = r.mean(0)
            self.known[s, e] = ((r.min(0), r.max(0)), centre, math.sqrt(float(((r - centre) ** 2).sum(1).max())))
        return self.known[s, e]


def join_sequences(p: Sequence, q: Sequence, cosine: float, on_links, on_all) -> None:
    """Near pairs of two sequences (or of one with itself): on_links(i, j arrays) or on_all(interval, interval)."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    same = p is q

    def compare(a0, a1, b0, b1, own):
        near = p.square[a0:a1, None] + q.square[None, b0:b1] - 2 * (p.narrow[a0:a1] @ q.narrow[b0:b1].T) <= eps * eps + NARROW_SLACK
        if own:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        for at in range(0, len(i), 1 << 15):
            u, v = i[at : at + (1 << 15)] + a0, j[at : at + (1 << 15)] + b0
            hit = np.einsum("ij,ij->i", p.x[u], q.x[v]) >= cosine
            if hit.any():
                on_links(u[hit], v[hit])

    def join(a0, a1, b0, b1):
        (box_a, ca, ra), (box_b, cb, rb) = p.of(a0, a1), q.of(b0, b1)
        if box_gap(box_a, box_b) > eps + SLACK:
            return
        own = same and (a0, a1) == (b0, b1)
        if math.sqrt(float(((ca - cb) ** 2).sum())) + ra + rb < eps - SLACK:
            on_all((a0, a1), (b0, b1), own)
        elif a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            compare(a0, a1, b0, b1, own)
        else:
            for i, (s, e) in enumerate(halves(a0, a1, LEAF)):
                for j, (t, u) in enumerate(halves(b0, b1, LEAF)):
                    if not own or i <= j:
                        join(s, e, t, u)

    if len(p.x) and len(q.x):
        join(0, len(p.x), 0, len(q.x))


# --- rows ---------------------------------------------------------------------


def _tag(kind: str):
    """Rows (id, k1, k2, dim, vec): the digest of a vector that can link, else nulls."""
    schema = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, v in zip(batch.column("id").to_pylist(), batch.column("vec")):
                raw = None
                if i is not None and v.is_valid and v.values is not None and len(v.values) and not v.values.null_count:
                    a = v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
                    if np.isfinite(a).all() and a.any():
                        raw = a.tobytes()
                if raw is None:
                    rows.append((i, None, None, None, None))
                else:
                    d = hashlib.blake2b(raw, digest_size=16).digest()
                    rows.append((i, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), len(a), raw))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, schema)], schema=schema)

    return run, "id long, k1 long, k2 long, dim int, vec binary"


def _vectors(column, kind: str) -> np.ndarray:
    """Unit vectors in double precision of a column of equally long raw vectors."""
    rows = column.to_pylist()
    raw = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.empty((0, 0), kind)
    return unit(raw.astype(np.float64))


def _place(kind: str, rotation: np.ndarray, bounds: list[tuple], eps: float):
    """Rows (interval, cells, lead, cid, m, vec) of classes."""
    from bisect import bisect_right

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rot = _vectors(batch.column("vec"), kind) @ rotation
            cells = grid_cells(rot, eps)
            at = [bisect_right(bounds, tuple(c)) for c in cells.tolist()]
            yield pa.record_batch([pa.array(at, pa.int64()), pa.array(list(cells), pa.list_(pa.int64())), pa.array(list(rot[:, :GRID]), pa.list_(pa.float64())), *[batch.column(c) for c in ("cid", "m", "vec")]], ["interval", "cells", "lead", "cid", "m", "vec"])

    return run, "interval long, cells array<long>, lead array<double>, cid long, m long, vec binary"


def _cut(rows_of_block: int):
    """Blocks of consecutive rows of each interval, of batches in grid order."""

    def run(batches):
        now, n = None, 0
        for batch in batches:
            interval = batch.column("interval").to_numpy()
            part = np.empty(len(interval), np.int64)
            starts = [0, *(np.flatnonzero(interval[1:] != interval[:-1]) + 1).tolist(), len(interval)]
            for lo, hi in zip(starts, starts[1:]):
                if lo == hi:
                    continue
                if interval[lo] != now:
                    now, n = interval[lo], 0
                part[lo:hi] = (n + np.arange(hi - lo)) // rows_of_block
                n += hi - lo
            yield pa.record_batch([batch.column("interval"), pa.array(part), *[batch.column(c) for c in ("lead", "cid", "m", "vec")]], ["interval", "part", "lead", "cid", "m", "vec"])

    return run, "interval long, part long, lead array<double>, cid long, m long, vec binary"


def _compare(kind: str, rotation: np.ndarray | None, cosine: float, eps: float):
    """Weighted link counts and forest edges of each group of rows (pair, side, cid, m, vec).

    side 0 and 1 are compared with each other, side 2 with itself.
    """
    schema = pa.schema([("edge", pa.bool_()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for _, group in runs(batches, ["pair"]):
            side, cid, m = (group.column(c).to_numpy() for c in ("side", "cid", "m"))
            x = _vectors(group.column("vec"), kind)
            rot = x if rotation is None else x @ rotation
            order = np.lexsort([cid, *grid_cells(rot, eps).T[::-1]])
            cid, m, x, rot, side = cid[order], m[order], x[order], rot[order], side[order]
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            p = Sequence(x[left], rot[left])
            q = p if (side == 2).any() else Sequence(x[right], rot[right])
            count, unions, edges = np.zeros(len(cid), np.int64), Unions(len(cid)), []

            def tie(i, j):
                if unions.join(i, j):
                    edges.append((cid[i], cid[j]))

            def links(i, j):
                i, j = left[i], right[j]
                np.add.at(count, i, m[j])
                np.add.at(count, j, m[i])
                for u, v in zip(i.tolist(), j.tolist()):
                    tie(u, v)

            def every(a, b, own):
                i, j = left[a[0] : a[1]], right[b[0] : b[1]]
                if own:
                    count[i] += m[i].sum() - m[i]
                else:
                    count[i] += m[j].sum()
                    count[j] += m[i].sum()
                for u in i.tolist():
                    tie(u, int(j[0]))
                for v in j.tolist():
                    tie(int(i[0]), v)

            join_sequences(p, q, cosine, links, every)
            some = np.flatnonzero(count)
            yield pa.record_batch([pa.array(np.zeros(len(some), bool)), pa.array(cid[some]), pa.array(count[some])], schema=schema)
            if edges:
                a, b = zip(*edges)
                yield pa.record_batch([pa.array([True] * len(a)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run, "edge boolean, a long, b long"


def _compared(rows: DataFrame, *how) -> DataFrame:
    run, ddl = _compare(*how)
    return rows.select("pair", "side", "cid", "m", "vec").repartition("pair").sortWithinPartitions("pair").mapInArrow(run, ddl)


def _find(classes: DataFrame, n: int, kind: str, cosine: float, eps: float, block: int) -> DataFrame:
    """Counts and edges among the n classes of one dimension."""
    spark = classes.sparkSession
    sample = smallest(classes, F.xxhash64("cid"), SAMPLE, n, ["vec"]).toArrow()
    x = _vectors(sample.column("vec"), kind)
    rotation = fit_rotation(x)
    cells = sorted(map(tuple, grid_cells(x @ rotation, eps).tolist()))
    rows_of_block = block_rows(n, block)
    intervals = min(MOST_INTERVALS, -(-n // rows_of_block))
    bounds = sorted({cells[len(cells) * i // intervals] for i in range(1, intervals)})

    run, ddl = _place(kind, rotation, bounds, eps)
    placed = classes.select("cid", "m", "vec").mapInArrow(run, ddl)
    run, ddl = _cut(rows_of_block)
    placed = materialize(placed.repartition(max(1, intervals), "interval").sortWithinPartitions("interval", "cells", "cid").mapInArrow(run, ddl), "ego-placed")

    lead = min(GRID, len(rotation))
    box = [f(F.col("lead")[i]).alias(f"{name}{i}") for i in range(lead) for name, f in (("lo", F.min), ("hi", F.max))]
    found = sorted(placed.groupBy("interval", "part").agg(*box).collect())
    lo, hi = (np.array([[r[f"{name}{i}"] for i in range(lead)] for r in found]).reshape(-1, lead) for name in ("lo", "hi"))

    def partners(batches):
        boxes = Boxes(lo, hi)
        for batch in batches:
            for a in batch.column(0).to_pylist():
                b = block_partners(boxes, a, eps)
                yield pa.record_batch([pa.array([a] * len(b), pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    many = len(found)
    pairs = materialize(spark.range(0, many, 1, max(1, min(many, 200))).mapInArrow(partners, "a long, b long"), "ego-pairs")
    pair = F.col("a") * many + F.col("b")
    sides = pairs.select(pair.alias("pair"), F.col("a").alias("block"), F.when(F.col("a") == F.col("b"), 2).otherwise(0).alias("side"))
    sides = sides.unionByName(pairs.filter("a <> b").select(pair.alias("pair"), F.col("b").alias("block"), F.lit(1).alias("side")))
    number = spark.createDataFrame([(r["interval"], r["part"], i) for i, r in enumerate(found)], "interval long, part long, block long")
    numbered = sized_join(placed.select("interval", "part", "cid", "m", "vec"), number, ["interval", "part"], rows=many)
    return _compared(sized_join(numbered, sides, "block"), kind, rotation, cosine, eps)


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component) for each row; one with a null id: 0 and null."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    kind = "f4" if isinstance(rows.schema["vec"].dataType.elementType, T.FloatType) else "f8"
    if kind == "f8":
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) or SLACK
    run, ddl = _tag(kind)
    rows = materialize(rows.mapInArrow(run, ddl), "ego-rows")
    classes = rows.filter("k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("m"), F.min("id").alias("lead"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "ego-classes")

    # one row for each dimension; dimensions of a block or less go together, each a group
    dims = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    large = [d for d, n in dims.items() if n > block]
    small = classes.filter(~F.col("dim").isin(large)) if large else classes
    found = _compared(small.withColumn("pair", F.col("dim").cast("long")).withColumn("side", F.lit(2)), kind, None, cosine, eps)
    for d in large:
        found = found.unionByName(_find(classes.filter(F.col("dim") == d), dims[d], kind, cosine, eps, block))
    found = materialize(found, "ego-found")

    links = found.filter("not edge").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("others"))
    comps = connected_components(found.filter("edge")).withColumnRenamed("node", "cid")
    own = classes.select("k1", "k2", "m", "lead", "cid")
    least = own.join(comps, "cid").groupBy("component").agg(F.min("lead").alias("least"))
    own = own.join(links, "cid", "left").join(comps.join(least, "component"), "cid", "left")
    own = materialize(own.select("k1", "k2", "m", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("least", "lead").alias("c")), "ego-own")
    out = join_by_hot_key(rows.select("id", "k1", "k2"), own, ["k1", "k2"], "m", rows.count())
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "id").alias("component"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: links and components of all embeddings at cosine 0.95."""
    out = near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT x, x AS y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON u.x = r.y),
n AS (SELECT x, count(*) AS n FROM u GROUP BY x),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""
