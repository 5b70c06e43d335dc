"""Reports as rows (report, ord, text), and their writer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.state import by_key, ensure_checkpoints, keep
from . import chains, conventions, graph, rules, symbols
from .text import line_budget

# Lines a report may have, and rows of its sections.
BUDGETS = {"architecture": 200, "map": 300, "context": 200}
LIMITS = {"hubs": 12, "details": 3, "importers": 5, "runtime": 10, "tooling": 5, "barrel": 5, "directories": 12, "cycles": 5, "state": 8,
          "models": 15, "other models": 10, "symbol files": 40, "symbols": 12, "callers": 2, "styles": 4, "verbs": 5, "clusters": 6, "cluster files": 5, "modules": 8, "chains": 8, "integrations": 3}


def _lines(rows: DataFrame, text: Column, order: list, most: int | None = None, more: bool = False) -> DataFrame:
    """(n, text): the first rows in order, and how many there are more of. Rows are a report's, or cut by a limit before any window."""
    head = rows if most is None else rows.orderBy(*order).limit(most)
    out = head.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("n"), text.alias("text"))
    if more:
        rest = rows.agg((F.count("*") - most).alias("rest")).filter("rest > 0")
        out = out.union(rest.select(F.lit(1 << 39), F.concat(F.lit("- ...and "), F.col("rest").cast("string"), F.lit(" more"))))
    return out


def _section(rows: DataFrame, title: str) -> DataFrame:
    """(n, text) with a heading and a blank; nothing where there are no rows."""
    some = rows.agg(F.count("*").alias("c")).filter("c > 0")
    ends = some.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit(title).alias("text")), F.struct(F.lit(1 << 40).alias("n"), F.lit("").alias("text")))).alias("x")).select("x.*")
    return rows.union(ends)


def _item(*parts) -> Column:
    return F.concat(F.lit("- "), F.concat_ws(" ", *parts))


def _hub_details(links: DataFrame, files: DataFrame, hubs: DataFrame, rel) -> DataFrame:
    """(n, text) of the first hubs: reach, and the application files that import them."""
    top = hubs.filter(F.col("rank") <= LIMITS["details"]).select("file", "rank")
    app = graph.between(links, files, graph.app(), ("source",))
    reach = graph.blast_radius(app).join(F.broadcast(top), "file")
    head = reach.select("rank", F.lit(0).alias("i"), F.concat(F.lit("**"), F.col("rank").cast("string"), F.lit(". "), rel(F.col("file")), F.lit("** reaches "), F.col("blast").cast("string"), F.lit(" files: "), F.col("direct").cast("string"), F.lit(" direct, "), F.col("indirect").cast("string"), F.lit(" indirect")).alias("text"))
    direct = app.filter("source <> target").select(F.col("target").alias("file"), "source").distinct().join(F.broadcast(top), "file")
    ranked = direct.withColumn("i", F.row_number().over(Window.partitionBy("file").orderBy("source"))).filter(F.col("i") <= LIMITS["importers"])
    listed = ranked.select("rank", "i", F.concat(F.lit("  - "), rel(F.col("source"))).alias("text"))
    rest = reach.filter(F.col("direct") > LIMITS["importers"]).select("rank", F.lit(LIMITS["importers"] + 1).alias("i"), F.concat(F.lit("  - ...and "), (F.col("direct") - LIMITS["importers"]).cast("string"), F.lit(" more")).alias("text"))
    rows = head.unionByName(listed).unionByName(rest)
    return rows.select((F.col("rank") * 100 + F.col("i")).cast("long").alias("n"), "text")


def _architecture(files: DataFrame, links: DataFrame, rel) -> list[DataFrame]:
    c, s = F.col, lambda x: F.col(x).cast("string")
    app = files.filter("file_class = 'app'")
    circular = links.filter("type = 'circular' and source <> target").agg(F.ceil(F.count("*") / 2).alias("cycles"))
    counts = files.agg(F.count("*").alias("files")).join(links.agg(F.count("*").alias("links"))).join(circular)
    header = counts.select(F.lit(0).cast("long").alias("n"), F.concat(F.lit("Files: "), s("files"), F.lit(" | Links: "), s("links"), F.lit(" | Cycles: "), s("cycles")).alias("text"))
    hubs = keep(graph.hubs(links, LIMITS["hubs"], files).join(by_key(graph.hub_risk(links, files)), "file", "left").na.fill({"importers": 0, "risk": "Low"}))
    entries = keep(rules.entry_points(app))
    state = rules.global_state(app)
    listed = conventions.test_summary(files)
    out = [header.union(header.select(F.lit(1).cast("long"), F.lit(""))),
           _section(_lines(hubs, F.concat_ws(" | ", s("rank"), rel(c("file")), F.concat(F.lit("out "), s("out_degree")), F.concat(F.lit("importers "), s("importers")), "risk"), ["rank"]), "## Hubs"),
           _section(_hub_details(links, files, hubs, rel), "### Hub details")]
    for category, title in (("runtime", "Runtime"), ("tooling", "Scripts and tooling"), ("barrel", "Re-exports")):
        own = entries.filter(c("category") == category)
        routes = F.when(c("route_count") > 0, F.concat(F.lit("("), s("route_count"), F.lit(")")))
        out.append(_section(_lines(own, _item(rel(c("path")), "reason", routes, "confidence"), rules.entry_order(), LIMITS[category], True), f"## Entry points: {title}"))
    return [*out,
            _section(_lines(graph.directory_stats(app, LIMITS["directories"]), _item(F.concat(rel(c("dir")), F.lit("/:")), s("files"), "purpose"), [F.desc("files"), "dir"]), "## Directories"),
            _section(_lines(chains.circular_pairs(links, LIMITS["cycles"], files), _item(rel(c("a")), F.lit("<->"), rel(c("b"))), ["a", "b"]), "## Circular"),
            _section(_lines(state, _item(F.concat(rel(c("file")), F.lit(":")), "message"), ["file", "message"], LIMITS["state"], True), "## Shared state"),
            _section(listed, "## Tests")]


def _map(files: DataFrame, links: DataFrame, rel) -> list[DataFrame]:
    c, s = F.col, lambda x: F.col(x).cast("string")
    app = files.filter("file_class = 'app'")
    models = keep(symbols.data_models(app).withColumn("group", symbols.model_group(c("family"))))
    out = []
    for group, title in (("orm", "Database models"), ("dataclass", "Data classes"), ("interface", "Interfaces and types"), ("other", "Other structures")):
        most = LIMITS["other models" if group == "other" else "models"]
        out.append(_section(_lines(models.filter(c("group") == group), _item(F.concat(rel(c("file")), F.lit(":")), "name", F.when(c("signature") != "", F.concat(F.lit("("), "signature", F.lit(")")))), ["file", "name"], most), f"## Models: {title}"))
    found = models.select("file").union(rules.entry_points(app).select(c("path").alias("file"))).union(rules.integrations(app).select("file"))
    linked = links.select(F.explode(F.array("source", "target")).alias("path")).distinct()
    top = keep(conventions.symbol_index(files.join(by_key(linked), "path", "left_semi"), links, found, LIMITS["symbol files"]))
    own = keep(symbols.symbols(files.join(F.broadcast(top.select(c("file").alias("path"))), "path", "left_semi")))
    used = symbols.callers(own, links, files).withColumn("used_in", F.slice(F.array_sort("used_in"), 1, LIMITS["callers"]))
    rows = own.join(used, ["path", "name"], "left").withColumnRenamed("path", "file").join(F.broadcast(top), "file")
    w = Window.partitionBy("file")
    rows = rows.withColumn("r", F.row_number().over(w.orderBy("ord", "name", "kind"))).withColumn("total", F.count("*").over(w)).filter(c("r") <= LIMITS["symbols"] + 1)
    line = F.concat_ws(" | ", rel(c("file")), F.concat("name", F.coalesce("signature", F.lit(""))), "kind", F.coalesce(F.array_join("used_in", ", "), F.lit("-")))
    line = F.when(c("r") > LIMITS["symbols"], F.concat(rel(c("file")), F.lit(" | +"), (c("total") - LIMITS["symbols"]).cast("string"), F.lit(" more symbols"))).otherwise(line)
    naming = rules.file_naming(app)
    verbs = keep(symbols.function_naming(app))  # a section reads its rows twice
    return [*out,
            _section(_lines(rows, F.concat(F.lit("- "), line), [F.desc("score"), "file", "r"]), "## Symbols"),
            _section(_lines(naming, _item(F.concat("style", F.lit(":")), s("n"), rel(c("example")), F.when(c("dominant"), "(use for new files)")), [F.desc("n"), "style"], LIMITS["styles"]), "## File names"),
            _section(_lines(verbs, _item(F.concat("verb", F.lit(":")), s("n"), "example"), [F.desc("n"), "verb"], LIMITS["verbs"]), "## Function names"),
            _section(_lines(conventions.frameworks(app), _item("name"), ["name"]), "## Frameworks")]


def _context(files: DataFrame, links: DataFrame, rel) -> list[DataFrame]:
    c, s = F.col, lambda x: F.col(x).cast("string")
    # a section's few lines are kept: they are read twice, and all sections in one plan are much for the driver
    told = lambda *x: keep(_lines(*x))
    app = files.filter("file_class = 'app'")
    links = keep(graph.between(links, files, graph.app()))
    if links.isEmpty():
        return [files.sparkSession.createDataFrame([(0, "No links between application files.")], "n long, text string")]
    found = chains.module_clusters(links, rel=rel(F.col("f"))).limit(LIMITS["clusters"])
    shown = F.concat(F.array_join(F.slice("files", 1, LIMITS["cluster files"]), ", "), F.when(F.size("files") > LIMITS["cluster files"], F.concat(F.lit(" and "), (F.size("files") - LIMITS["cluster files"]).cast("string"), F.lit(" more"))).otherwise(""))
    entries = rules.entry_points(app).filter("category = 'runtime'").select(c("path").alias("start"))
    chain = F.array_join(F.transform("chain", rel), " -> ")
    grouped = rules.integrations(app).withColumn("group", F.explode(rules.integration_group(c("message"))))
    ranked = grouped.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("file", "message"))).filter(c("r") <= LIMITS["integrations"])
    order = F.array_position(F.array(*map(F.lit, ("database", "http", "queue", "other"))), c("group"))
    notes = files.sparkSession.createDataFrame([(0, "- Files that change together: clusters."), (1, "- Where data goes: modules and chains."), (2, "- Outer services: integrations.")], "n long, text string")
    return [_section(told(found, _item(F.concat("name", F.lit(":")), shown, F.concat(F.lit("("), "reason", F.lit(")"))), [F.desc("score"), "name"]), "## Clusters"),
            _section(told(graph.centrality(links, LIMITS["modules"], files), _item(F.concat(rel(c("file")), F.lit(":")), F.lit("callers"), s("in_degree"), F.lit("dependencies"), s("out_degree")), [F.desc("score"), "file"]), "## Modules"),
            _section(told(chains.dependency_chains(links, entries), F.concat(F.lit("- "), chain), [F.desc("depth"), chain], LIMITS["chains"]), "## Chains"),
            _section(told(ranked, _item(F.concat("group", F.lit(":")), rel(c("file")), "message"), [order, "r"]), "## Integrations"),
            _section(told(conventions.layer_flows(app), _item("name"), ["name"]), "## Flows"),
            _section(notes, "## Reference")]


def build(kind: str, files: DataFrame, links: DataFrame, generated_at: str = "", root: str = "") -> DataFrame:
    """report_lines of one report: architecture, map or context, within its line budget.

    Files: path, rel, dir, stem, ext, file_class, content; links: source, target, type,
    strength, symbols. A section without rows is left out. ``generated_at`` closes the
    report. Files and links are checkpointed first: sections read them many times.
    """
    makers = {"architecture": _architecture, "map": _map, "context": _context}
    if kind not in makers:
        raise ValueError(f"no report {kind!r}")
    spark = files.sparkSession
    ensure_checkpoints(spark)
    files, links = keep(files), keep(links)
    parts = makers[kind](files, links, lambda c: P.relative(c, root))
    all_of = [df.select(F.col("n").cast("long").alias("n"), "text").withColumn("part", F.lit(i)) for i, df in enumerate(parts, 1)]
    all_of += [spark.createDataFrame([(0, f"# {kind}"), (1, "")], "n long, text string").withColumn("part", F.lit(0)), spark.createDataFrame([(0, f"Generated: {generated_at}")], "n long, text string").withColumn("part", F.lit(99))]
    rows = reduce(DataFrame.unionByName, all_of).withColumn("report", F.lit(kind))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("report").orderBy("part", "n")).cast("long"))
    return line_budget(rows.select("report", "ord", "text"), BUDGETS[kind])


def write(report: DataFrame, folder: str) -> None:
    """One text file of a report, which has a few hundred lines at most."""
    report.coalesce(1).sortWithinPartitions("ord").select("text").write.mode("overwrite").text(folder)
