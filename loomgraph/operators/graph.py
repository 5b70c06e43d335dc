"""Operators on any edges (source, target[, type, strength]) DataFrame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.state import by_key, keep

#: An importer of more targets than this has its pairs made by several tasks.
SPLIT = 5000
#: A graph of at most so many edges (about 200 MB of text, 100 MB of numbers) is searched by one task.
SMALL = 2_000_000


def between(edges: DataFrame, files: DataFrame, of: Column, ends=("source", "target")) -> DataFrame:
    """The edges whose given ends are files (path, ...) for which ``of`` holds."""
    chosen = files.filter(of).select("path").distinct()
    for end in ends:
        edges = edges.join(by_key(chosen.withColumnRenamed("path", end)), end, "left_semi")
    return edges


def app(files_class: str = "file_class") -> Column:
    return F.col(files_class) == "app"


def structural() -> Column:
    return P.is_structural(F.col("rel"))


def degrees(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, in_degree, out_degree); of ``files`` (path) where given, else of all endpoints."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    out = ends.groupBy("file").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    if files is None:
        return out
    return files.select(F.col("path").alias("file")).distinct().join(by_key(out), "file", "left").na.fill(0, ["in_degree", "out_degree"])


def hubs(edges: DataFrame, n: int = 12, files: DataFrame | None = None) -> DataFrame:
    """The n files of the highest 2 * (in + out) among those with more than two links, ranked.

    With ``files`` (path, rel) only structural application files are ranked, by all their links.
    """
    d = degrees(edges).filter("in_degree + out_degree > 2").withColumn("score", 2 * (F.col("in_degree") + F.col("out_degree")))
    if files is not None:
        d = d.join(by_key(files.filter(structural()).select(F.col("path").alias("file"))), "file", "left_semi")
    top = d.orderBy(F.desc("score"), "file").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "file")).cast("long"))


def hub_risk(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file, importers, risk): more than 8 distinct importers High, more than 4 Medium, else Low.

    With ``files`` (path, file_class) only application files count as importers.
    """
    e = edges.filter("source <> target")
    if files is not None:
        e = between(e, files, app(), ("source",))
    d = e.groupBy(F.col("target").alias("file")).agg(F.countDistinct("source").alias("importers"))
    return d.withColumn("risk", F.when(F.col("importers") > 8, "High").when(F.col("importers") > 4, "Medium").otherwise("Low"))


def centrality(edges: DataFrame, n: int = 8, files: DataFrame | None = None) -> DataFrame:
    """(file, score, in_degree, out_degree) of the n files of the highest 2 * in + out, self links aside.

    With ``files`` (path, rel, file_class): over links between application files, structural ones ranked.
    """
    e = edges.filter("source <> target")
    if files is not None:
        e = between(e, files, app())
    d = degrees(e)
    if files is not None:
        d = d.join(by_key(files.filter(structural()).select(F.col("path").alias("file"))), "file", "left_semi")
    return d.select("file", (2 * F.col("in_degree") + F.col("out_degree")).alias("score"), "in_degree", "out_degree").orderBy(F.desc("score"), "file").limit(n)


def blast_radius(edges: DataFrame, first: int = 10, second: int = 3) -> DataFrame:
    """(file, direct, indirect, blast): importers, and those of its first importers, a few of each."""
    e = edges.filter("source <> target").select("source", "target").distinct()
    rank = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    ranked = e.withColumn("r", rank)
    near = ranked.filter(F.col("r") <= first).select(F.col("target").alias("file"), F.col("source").alias("via"))
    far = near.join(by_key(ranked.filter(F.col("r") <= second).select(F.col("target").alias("via"), F.col("source").alias("importer"))), "via")
    far = far.filter("importer <> file").groupBy("file").agg(F.countDistinct("importer").alias("indirect"))
    direct = e.groupBy(F.col("target").alias("file")).agg(F.count("*").alias("direct"))
    out = direct.join(by_key(far), "file", "left").na.fill(0, ["indirect"])
    return out.withColumn("blast", F.col("direct") + F.col("indirect"))


def co_import_pairs(edges: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared): targets a < b with at least ``least`` common importers.

    Only targets of so many importers can be in a pair, and only importers of two such
    targets make one. The pairs of an importer of many targets are made by several
    tasks: one side goes by salt, the other to each of the salts.
    """
    e = edges.filter("source <> target").select("source", "target").distinct()
    e = e.join(by_key(e.groupBy("target").count().filter(F.col("count") >= least).select("target")), "target", "left_semi")
    fan = e.groupBy("source").agg(F.count("*").alias("fan")).filter("fan > 1").select("source", F.ceil(F.col("fan") / SPLIT).cast("int").alias("salts"))
    e = e.join(by_key(fan), "source")
    left = e.select("source", F.col("target").alias("a"), F.pmod(F.xxhash64("target"), F.col("salts")).cast("int").alias("salt"))
    right = e.select("source", F.col("target").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(by_key(right), ["source", "salt"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def merge_reverse(edges: DataFrame) -> DataFrame:
    """(source, target, type, strength, bidirectional[, symbols, lines]): both directions as one edge, from the smaller source.

    The survivor's type stays; symbols are the union in its order, lines the two lists
    one after the other, strength grows by half of the other's, 1 at most.
    """
    more = [c for c in ("symbols", "lines") if c in edges.columns]
    row = F.struct("strength", "type", *more)
    low, high = F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")
    ahead = F.col("source") < F.col("target")
    # the strongest of several edges of one direction
    both = edges.filter("source <> target").groupBy(low, high).agg(F.max(F.when(ahead, row)).alias("one"), F.max(F.when(~ahead, row)).alias("two"))
    kept, lost = F.coalesce("one", "two"), F.col("two")
    two = F.col("one").isNotNull() & F.col("two").isNotNull()
    out = both.withColumn("kept", kept).withColumn("both", two)
    extra = []
    if "symbols" in more:
        extra.append(F.when(F.col("both"), F.array_distinct(F.concat("kept.symbols", lost["symbols"]))).otherwise(F.col("kept.symbols")).alias("symbols"))
    if "lines" in more:
        extra.append(F.when(F.col("both"), F.concat("kept.lines", lost["lines"])).otherwise(F.col("kept.lines")).alias("lines"))
    return out.select(
        F.when(F.col("one").isNotNull(), F.col("lo")).otherwise(F.col("hi")).alias("source"), F.when(F.col("one").isNotNull(), F.col("hi")).otherwise(F.col("lo")).alias("target"),
        F.col("kept.type").alias("type"), F.when(F.col("both"), F.least(F.lit(1.0), F.col("kept.strength") + 0.5 * lost["strength"])).otherwise(F.col("kept.strength")).alias("strength"),
        F.col("both").alias("bidirectional"), *extra)


def _risk(n: Column) -> Column:
    return F.when(n >= 5, "HIGH").when(n >= 3, "MEDIUM").otherwise("LOW")


def _dependents(edges: DataFrame, target, files: DataFrame | None) -> DataFrame:
    """(file): distinct dependents; application and test files where there are some, never third-party ones."""
    dep = edges.filter((F.col("target") == F.lit(target)) & (F.col("source") != F.lit(target))).select(F.col("source").alias("file")).distinct()
    if files is None:
        return dep
    # a dependent that isn't listed has no class; those of a class go first
    known = files.select(F.col("path").alias("file"), "file_class").distinct()
    dep = dep.join(known, "file", "left").filter("file_class is null or file_class <> 'third_party'")
    some = dep.agg(F.coalesce(F.max(F.col("file_class").isNotNull()), F.lit(False)).alias("some"))
    return dep.join(F.broadcast(some)).filter("not some or file_class is not null").select("file")


def impact(edges: DataFrame, target, n: int = 5, files: DataFrame | None = None) -> DataFrame:
    """(dependent, in_degree, dependents, risk): the n dependents of a file with most links of their own.

    With ``files`` (path, file_class) third-party dependents go.
    """
    dep = _dependents(edges, target, files)
    out = dep.join(degrees(edges).select("file", "in_degree"), "file").join(F.broadcast(dep.agg(F.count("*").alias("dependents"))))
    return out.select(F.col("file").alias("dependent"), "in_degree", "dependents", _risk(F.col("dependents")).alias("risk")).orderBy(F.desc("in_degree"), "dependent").limit(n)


def impact_summary(edges: DataFrame, files: DataFrame, target: str, n: int = 5) -> DataFrame:
    """One row (file, dependents_count, top_dependents, hub_risk) for a file of ``files`` (path, file_class).

    A third-party file has none and is LOW; a test is MEDIUM at most.
    """
    own = files.filter(F.col("path") == target).agg(F.coalesce(F.max("file_class"), F.lit("app")).alias("cls"))
    top = impact(edges, target, n, files)
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("in_degree")).alias("d"), "dependent"))), lambda x: F.struct(x["dependent"].alias("file"), (-x["d"]).alias("dependent_count")))
    found = top.agg(F.coalesce(F.max("dependents"), F.lit(0)).alias("n"), rows.alias("top")).join(own)
    out = F.col("cls") == "third_party"
    risk = F.when(out, "LOW").when((F.col("cls") == "test") & (F.col("n") >= 5), "MEDIUM").otherwise(_risk(F.col("n")))
    return found.select(F.lit(target).alias("file"), F.when(out, 0).otherwise(F.col("n")).alias("dependents_count"), F.when(out, F.array().cast("array<struct<file: string, dependent_count: bigint>>")).otherwise(F.col("top")).alias("top_dependents"), risk.alias("hub_risk"))


def neighbourhood(edges: DataFrame, file) -> DataFrame:
    """The links from or to a file."""
    return edges.filter((F.col("source") == F.lit(file)) | (F.col("target") == F.lit(file)))


def focus_metrics(edges: DataFrame, file) -> DataFrame:
    """(file, imports, exports, calls, total, circular, is_hub, importance) of a neighbourhood's nodes.

    Circular links are neither imports nor exports. The file itself is always a node,
    the only one where no link has it.
    """
    near = neighbourhood(edges, file)
    end = lambda c, i, x: F.struct(F.col(c).alias("file"), F.lit(i).alias("i"), F.lit(x).alias("e"), "type")
    ends = near.select(F.explode(F.array(end("source", 1, 0), end("target", 0, 1))).alias("x")).select("x.*")
    own = edges.sparkSession.range(1).select(F.lit(file).alias("file"), F.lit(0).alias("i"), F.lit(0).alias("e"), F.lit("").alias("type"))
    of = lambda c, kind: F.sum(F.when(F.col("type") == kind, F.col(c)).otherwise(0))
    out = ends.unionByName(own).groupBy("file").agg(of("i", "import").alias("imports"), of("e", "import").alias("exports"), of("i", "call").alias("calls"), F.max(F.col("type") == "circular").alias("circular"))
    out = out.withColumn("total", F.col("imports") + F.col("exports") + F.col("calls"))
    hub = (F.col("file") == F.lit(file)) | (F.col("total") > 5) | F.col("circular")
    return out.withColumn("is_hub", hub).withColumn("importance", F.col("total") + F.when(F.col("circular"), 5).otherwise(0))


def focused_graph(edges: DataFrame, file) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, links, one row of counts) of a file's neighbourhood."""
    near = neighbourhood(edges, file)
    counts = near.agg(F.count("*").alias("links"), F.count(F.when(F.col("type") == "circular", 1)).alias("circular"))
    return focus_metrics(edges, file), near, counts


def _reach(edges: DataFrame, max_steps: int) -> DataFrame:
    """(node, fw, bw): the least node that reaches a node, and the least that it reaches, itself included.

    A step takes the neighbours' labels, then the label of the label: what reaches the
    node that reaches me reaches me too. So a chain is passed in steps of its logarithm.
    """
    out = keep(edges.select(F.explode(F.array("source", "target")).alias("node")).distinct().select("node", F.col("node").alias("fw"), F.col("node").alias("bw")))
    for _ in range(max_steps):
        ahead = edges.join(out.select(F.col("node").alias("source"), "fw"), "source").select(F.col("target").alias("node"), "fw", F.lit(None).alias("bw"))
        back = edges.join(out.select(F.col("node").alias("target"), "bw"), "target").select(F.col("source").alias("node"), F.lit(None).alias("fw"), "bw")
        told = ahead.unionByName(back).groupBy("node").agg(F.min("fw").alias("nf"), F.min("bw").alias("nb"))
        near = out.join(told, "node", "left").select("node", F.least("fw", "nf").alias("fw"), F.least("bw", "nb").alias("bw"), F.col("fw").alias("of"), F.col("bw").alias("ob"))
        near = near.join(out.select(F.col("node").alias("fw"), F.col("fw").alias("jf")), "fw").join(out.select(F.col("node").alias("bw"), F.col("bw").alias("jb")), "bw")
        step = keep(near.select("node", F.least("fw", "jf").alias("fw"), F.least("bw", "jb").alias("bw"), "of", "ob"))
        out = step.select("node", "fw", "bw")
        if step.filter("fw < of or bw < ob").isEmpty():
            return out
    raise RuntimeError("labels did not settle")


def _groups(starts: list[int], targets: list[int]) -> list[list[int]]:
    """Strongly connected groups of more than one node, depth first without recursion; node n's targets are targets[starts[n]:starts[n + 1]]."""
    n = len(starts) - 1
    order, low, at, on = [-1] * n, [0] * n, starts[:n], bytearray(n)
    stack, out, seen = [], [], 0
    for root in range(n):
        if order[root] >= 0:
            continue
        path = [root]
        while path:
            node = path[-1]
            if order[node] < 0:
                order[node] = low[node] = seen
                seen += 1
                stack.append(node)
                on[node] = 1
            end = starts[node + 1]
            while at[node] < end:
                t = targets[at[node]]
                at[node] += 1
                if order[t] < 0:
                    path.append(t)
                    break
                if on[t]:
                    low[node] = min(low[node], order[t])
            else:
                path.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        on[group[-1]] = 0
                    if len(group) > 1:
                        out.append(group)
    return out


def _small_components(edges: DataFrame) -> DataFrame:
    kind = edges.schema["source"].dataType.simpleString()
    ends = pa.string() if kind == "string" else pa.int64()

    def run(batches):
        columns = [c.cast(ends) for batch in batches for c in (batch.column(0), batch.column(1))]
        # nodes are numbers from here on; names are taken for those of a group only
        coded = pa.chunked_array(columns[::2] + columns[1::2], ends).combine_chunks().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy()
        source, target = codes[: len(codes) // 2], codes[len(codes) // 2 :]
        columns.clear()
        starts = np.r_[0, np.cumsum(np.bincount(source, minlength=len(names)))]
        groups = _groups(starts.tolist(), target[np.argsort(source, kind="stable")].tolist())
        cols: tuple[list, list, list] = ([], [], [])
        for group in groups:
            nodes = names.take(pa.array(group)).to_pylist()
            for col, values in zip(cols, (nodes, [min(nodes)] * len(nodes), [len(nodes)] * len(nodes))):
                col += values
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (ends, ends, pa.int64()))], ["node", "component", "size"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, component {kind}, size long")


def strong_components(edges: DataFrame, max_steps: int = 1000) -> DataFrame:
    """(node, component, size) of strongly connected groups of more than one node.

    A graph of at most SMALL counted edges is searched depth first by one task. Beyond
    that it stays distributed: in a round every node takes the least node that reaches it and the least that it
    reaches. Where they are the same one, it is the least of the node's group. Nodes of
    one group agree in both, so only edges between nodes that do and are in no group yet
    go on to the next round. Needs a checkpoint folder (see plans.state).
    """
    left = keep(edges.filter("source <> target").select("source", "target").distinct())
    if left.count() <= SMALL and left.schema["source"].dataType.simpleString() in ("string", "bigint"):
        return keep(_small_components(left))
    found = None
    for _ in range(max_steps):
        labels = _reach(left, max_steps)
        done = labels.filter("fw = bw").select("node", F.col("fw").alias("component"))
        found = done if found is None else found.union(done)
        open_ = labels.filter("fw <> bw")
        ends = [open_.select(F.col("node").alias(end), F.col("fw").alias(f"f_{end}"), F.col("bw").alias(f"b_{end}")) for end in ("source", "target")]
        left = keep(left.join(ends[0], "source").join(ends[1], "target").filter("f_source = f_target and b_source = b_target").select("source", "target"))
        if left.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    size = found.groupBy("component").agg(F.count("*").alias("size")).filter("size > 1")
    return found.join(size, "component").select("node", "component", "size")


def mark_circular(edges: DataFrame) -> DataFrame:
    """edges with type circular and strength + 0.3, 1 at most, inside a strong component; other columns stay."""
    c = strong_components(edges).select("node", "component")
    out = edges.join(by_key(c.select(F.col("node").alias("source"), F.col("component").alias("cs"))), "source", "left").join(by_key(c.select(F.col("node").alias("target"), F.col("component").alias("ct"))), "target", "left")
    inside = F.coalesce((F.col("cs") == F.col("ct")) & (F.col("source") != F.col("target")), F.lit(False))
    out = out.withColumn("type", F.when(inside, "circular").otherwise(F.col("type"))).withColumn("strength", F.when(inside, F.least(F.lit(1.0), F.col("strength") + 0.3)).otherwise(F.col("strength")))
    return out.select("source", "target", "type", "strength", *[x for x in edges.columns if x not in ("source", "target", "type", "strength")])


def graph_stats(edges: DataFrame, files: DataFrame | None = None, merged: bool = False) -> DataFrame:
    """One row: files, links, two-way pairs, cycle groups.

    ``files`` (path): all of them count, linked or not. ``merged`` counts the cycle
    groups after both directions of a pair became one edge, so pairs alone are none.
    """
    e = edges.filter("source <> target").select("source", "target").distinct()
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"))
    pairs = e.join(back, ["source", "target"]).filter("source < target").agg(F.count("*").alias("two_way"))
    groups = strong_components(merge_reverse(edges) if merged else e).agg(F.countDistinct("component").alias("cycle_groups"))
    listed = e.select(F.explode(F.array("source", "target")).alias("f")) if files is None else files.select(F.col("path").alias("f"))
    return listed.agg(F.countDistinct("f").alias("files")).join(e.agg(F.count("*").alias("links"))).join(pairs).join(groups)


def directory_stats(files: DataFrame, n: int = 12) -> DataFrame:
    """(dir, files, extensions, purpose) of the n fullest folders with two files or more; extensions with their counts."""
    each = files.groupBy("dir", "ext").agg(F.count("*").alias("c"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ext", "c"))), lambda x: F.concat_ws(":", x["ext"], x["c"].cast("string"))), ",")
    out = each.groupBy("dir").agg(F.sum("c").alias("files"), listed.alias("extensions"))
    return out.filter("files >= 2").orderBy(F.desc("files"), "dir").limit(n).withColumn("purpose", P.purpose(F.col("dir")))
