"""Greedy walks, clusters and listings over any edges (source, target)."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.state import by_key, keep
from .graph import between, co_import_pairs, structural


def walk(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, chain): from each start to the least target not yet on its chain, ``hops`` times at most.

    Starts are few: they go to the edges, which stay where they are. Each hop is kept, so
    no plan holds more than one of them.
    """
    e = edges.filter("source <> target").select("source", "target")
    at = keep(starts.select("start", F.array("start").alias("chain"), F.lit(True).alias("open")))
    for _ in range(hops):
        last = at.filter("open").select("start", "chain", F.element_at("chain", -1).alias("source"))
        step = e.join(F.broadcast(last), "source").filter(~F.array_contains("chain", F.col("target"))).groupBy("start").agg(F.min("target").alias("next"))
        at = keep(at.join(F.broadcast(step), "start", "left").select("start", F.when(F.col("next").isNull(), F.col("chain")).otherwise(F.concat("chain", F.array("next"))).alias("chain"), F.col("next").isNotNull().alias("open")))
    return at.select("start", "chain")


def dependency_chains(edges: DataFrame, entries: DataFrame | None = None, n: int = 5) -> DataFrame:
    """(chain, depth, start_path, starts_from_entry), the n best of three modules or more.

    Ten starts at most: entries (start) by name, then the eight of the highest
    in-degree. Fewer than three chains are filled from five further sources, four
    modules at most. An entry counts ten, each module one.
    """
    e = keep(edges.filter("source <> target").select("source", "target").distinct())
    top = e.groupBy(F.col("target").alias("start")).agg(F.count("*").alias("d")).orderBy(F.desc("d"), "start").limit(8).select("start", F.lit(1).alias("tier"), (-F.col("d")).alias("d"))
    if entries is not None:
        top = entries.select("start", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("d")).distinct().orderBy("start").limit(10).unionByName(top)
    top = keep(top.groupBy("start").agg(F.min(F.struct("tier", "d")).alias("o")).orderBy("o", "start").limit(10).select("start", (F.col("o.tier") == 0).alias("entry")))
    out = keep(walk(e, top, 4).filter(F.size("chain") >= 3).join(top, "start"))
    if out.count() < 3:
        more = e.select(F.col("source").alias("start")).distinct().join(top, "start", "left_anti").orderBy("start").limit(5)
        out = out.unionByName(walk(e, more, 3).filter(F.size("chain") >= 3).withColumn("entry", F.lit(False)))
    out = out.dropDuplicates(["chain"]).withColumn("score", F.when(F.col("entry"), 10).otherwise(0) + F.size("chain") + 1)
    best = out.orderBy(F.desc("score"), "start").limit(n)
    return best.select("chain", F.size("chain").alias("depth"), F.col("start").alias("start_path"), F.col("entry").alias("starts_from_entry"))


def circular_pairs(edges: DataFrame, n: int = 5, files: DataFrame | None = None) -> DataFrame:
    """(a, b): the first n unordered pairs of circular links; with ``files`` (path, rel) of structural application files."""
    c = edges.filter("type = 'circular' and source <> target")
    if files is not None:
        c = between(c, files, structural())
    return c.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().orderBy("a", "b").limit(n)


def cycle_count(edges: DataFrame) -> DataFrame:
    """One row: half the circular links, rounded up."""
    return edges.agg(F.ceil(F.count(F.when(F.col("type") == "circular", 1)) / 2).alias("cycles"))


_CLUSTER = pa.schema([("seed", pa.string()), ("members", pa.list_(pa.string())), ("files", pa.list_(pa.string())), ("name", pa.string()), ("score", pa.int64()), ("used", pa.string())])
_CLUSTER_DDL = "seed string, members array<string>, files array<string>, name string, score long, used string"


def _greedy(n: int, most: int):
    """The n best clusters of rows in order of their seeds' totals, and then the files that clusters used.

    A cluster's score is at most its seed's total, so the walk ends at a seed whose
    total the n-th best score has; no used files are told then.
    """

    def best(batches):
        used: set[str] = set()
        top: list[tuple] = []
        now, members, score, walked = None, [], 0, 0

        def close():
            nonlocal members, score, walked
            if now is not None and members:
                seed, tooling, total = now
                names = [seed, *[m for m, _ in members]]
                files = sorted({m for m, tool in [(seed, tooling), *members] if not tool})[:most]
                used.update(names)
                if len(files) >= 2:
                    parts = files[0].split("/")
                    name = parts[-2] if len(parts) > 1 else parts[-1]
                    name = name[:1].upper() + name[1:]
                    walked += 1  # of equal ones the first stays
                    heapq.heappush(top, (score, _Down(name), -walked, seed, names, files, name))
                    if len(top) > n:
                        heapq.heappop(top)
            members, score = [], 0

        ended = False
        for batch in batches:
            if ended:
                continue
            for seed, tooling, total, other, tool, shared in zip(*(batch.column(c).to_pylist() for c in ("seed", "seed_tool", "total", "other", "other_tool", "shared"))):
                if now is None or seed != now[0]:
                    close()
                    if len(top) == n and total < top[0][0]:
                        ended, now = True, None
                        break
                    now = (seed, tooling, total)
                if seed not in used:
                    members.append((other, tool))
                    score += shared
        close()
        rows = [(seed, names, files, name, score, None) for score, _, _, seed, names, files, name in sorted(top, key=lambda t: -t[2])]
        rows += [] if ended or len(top) >= 3 else [(None, None, None, None, None, u) for u in sorted(used)]
        yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_CLUSTER)], schema=_CLUSTER)

    return best


class _Down(str):
    """Strings in descending order."""

    def __lt__(self, other):
        return str.__gt__(self, other)


def module_clusters(edges: DataFrame, n: int = 7, rel: Column | None = None) -> DataFrame:
    """(name, files, reason, shared, score) of files that the same importers share, best first.

    Seeds go by the sum of what they share with later files; a seed takes the seven that
    share most with it, all of them are used then. Configuration files go, two files at
    least stay, eight at most are listed. The folder of the first file names a cluster,
    equal names get its parent folder or a number. The reason lists the first three
    shared importers, ``shared`` is their number. Fewer than three clusters among more
    than five targets are filled with folders (``directory_clusters``).

    The pairs are counted by all tasks; the greedy walk passes seven rows of each seed
    in order and stops at the first seed that can't be among the n best. ``rel`` is the
    name under which a file ``f`` is listed (default: as it is).
    """
    named = F.col("f").cast("string") if rel is None else rel
    e = edges.filter("source <> target").select("source", "target").distinct()
    pairs = keep(co_import_pairs(e))
    total = pairs.groupBy(F.col("a").alias("seed")).agg(F.sum("shared").alias("total"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
    near = pairs.withColumn("r", rank).filter("r <= 7").join(by_key(total), F.col("a") == F.col("seed"))
    label = lambda df, c: df.withColumn("f", F.col(c)).withColumn(c, named).drop("f")
    near = near.select("seed", "total", F.col("b").alias("other"), "shared", "r")
    near = label(label(near, "seed"), "other")
    near = near.withColumn("seed_tool", P.is_tooling(F.col("seed"))).withColumn("other_tool", P.is_tooling(F.col("other")))
    # written first: a global sort reads its input twice
    ordered = keep(near.select("seed", "seed_tool", "total", "other", "other_tool", "shared", "r")).orderBy(F.desc("total"), "seed", "r")
    found = keep(ordered.coalesce(1).mapInArrow(_greedy(n, 8), _CLUSTER_DDL))
    rows = found.filter("used is null").collect()  # n clusters; what they used, told of fewer than three, stays where it is
    clusters = sorted(((r["name"], r["files"], r["members"], r["score"], r["seed"]) for r in rows), key=lambda c: (-c[3], c[0]))
    spark = edges.sparkSession
    reasons = {}
    if clusters:
        of = spark.createDataFrame([(c[4], m) for c in clusters for m in c[2]], "seed string, f2 string")
        flat = label(e.withColumn("f2", F.col("target")), "f2").withColumn("importer", F.col("source"))
        hits = label(flat.select("f2", "importer"), "importer").join(F.broadcast(of), "f2")
        each = hits.groupBy("seed", "importer").agg(F.count("*").alias("c"), F.max(F.col("f2") == F.col("seed")).alias("own")).filter("own and c > 1")
        ranked = each.withColumn("i", F.row_number().over(Window.partitionBy("seed").orderBy("importer"))).filter("i <= 3")
        count = each.groupBy("seed").agg(F.count("*").alias("shared"))
        for r in ranked.groupBy("seed").agg(F.array_sort(F.collect_list("importer")).alias("first")).join(count, "seed").collect():
            reasons[r["seed"]] = (r["first"], r["shared"])
    out = []
    for name, files, _, score, seed in clusters:
        first, shared = reasons.get(seed, ([], 0))
        more = f" (+{shared - 3} more)" if shared > 3 else ""
        out.append((name, files, "Imported together by " + ", ".join(first) + more, shared, score))
    if len(out) < 3:
        targets = e.select("target").distinct().limit(6).count()
        if targets > 5:
            used = found.select(F.explode(F.when(F.col("used").isNull(), F.col("members")).otherwise(F.array("used"))).alias("file"))
            rest = label(e.select(F.explode(F.array("source", "target")).alias("file")).distinct(), "file")
            rest = rest.join(by_key(used), "file", "left_anti")
            for r in directory_clusters(rest.select(F.col("file").alias("source"), F.col("file").alias("target")), listed=8).collect():
                name = r["name"].rsplit("/", 1)[-1] or "Root"
                if len(out) < n and name not in [c[0] for c in out]:
                    out.append((name, r["first"], f"Files in {r['name']}/", 0, r["files"]))
    return spark.createDataFrame(_apart(out), "name string, files array<string>, reason string, shared long, score long")


def _apart(clusters: list[tuple]) -> list[tuple]:
    """Clusters of one name get the folder of their first file, or a number where folders agree too."""
    out = list(clusters)
    for name in {c[0] for c in clusters}:
        at = [i for i, c in enumerate(clusters) if c[0] == name]
        if len(at) > 1:
            parts = [(clusters[i][1] or [""])[0].split("/") for i in at]
            folders = [p[-2] if len(p) > 1 else p[0].rsplit(".", 1)[0] for p in parts]
            single = len(set(folders)) == len(folders) and all(folders)
            for k, i in enumerate(at):
                out[i] = (f"{name} ({folders[k]})" if single else f"{name} #{k + 1}", *clusters[i][1:])
    return out


def directory_clusters(edges: DataFrame, n: int = 3, listed: int = 0) -> DataFrame:
    """(name, files[, first]): the n folders with most endpoints, three or more; the fallback of few clusters.

    With ``listed`` configuration files don't count, and ``first`` has so many of a folder's files.
    """
    ends = edges.select(F.explode(F.array("source", "target")).alias("file")).distinct()
    if listed:
        ends = ends.filter(~P.is_tooling(F.col("file")))
    d = ends.withColumn("name", P.dirname(F.col("file")))
    top = d.groupBy("name").agg(F.count("*").alias("files")).filter("files >= 3").orderBy(F.desc("files"), "name").limit(n)
    if not listed:
        return top
    own = d.join(F.broadcast(top), "name").withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy("file"))).filter(F.col("i") <= listed)
    return own.groupBy("name", "files").agg(F.array_sort(F.collect_list("file")).alias("first")).orderBy(F.desc("files"), "name")
