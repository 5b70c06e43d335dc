"""One object from a folder of source files to its links, queries and reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import chains, extract, graph, report, resolve, rules, symbols, text
from .plans.state import ensure_checkpoints, keep
from .sources.scan import scan


def link_files(files: DataFrame, qualified_calls: bool = False) -> DataFrame:
    """links of files (path, rel, ext, dir, content): resolved, circular ones marked, both directions merged.

    (source, target, type, strength, bidirectional, symbols, lines)
    """
    ensure_checkpoints(files.sparkSession)
    links = resolve.links(resolve.resolve_imports(extract.imports(files), files))
    if qualified_calls:
        links = links.unionByName(resolve.call_links(extract.calls(files), files, True))
    return graph.merge_reverse(graph.mark_circular(keep(links)))


class Engine:
    """Queries over one workspace; files and links are read once and kept."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, ""
        self._files: DataFrame | None = None
        self._links: DataFrame | None = None

    def load(self, root: str, **options) -> Engine:
        """Scan a folder; options are those of ``sources.scan.scan``."""
        return self.of(scan(self.spark, root, **options), root)

    def of(self, files: DataFrame, root: str = "") -> Engine:
        """Take files that are rows already (path, rel, dir, stem, basename, ext, file_class, content)."""
        ensure_checkpoints(self.spark)
        self.root, self._files, self._links = root, keep(files), None
        return self

    def files(self) -> DataFrame:
        if self._files is None:
            raise RuntimeError("load a workspace first")
        return self._files

    def links(self) -> DataFrame:
        if self._links is None:
            self._links = keep(link_files(self.files()))
        return self._links

    def degrees(self) -> DataFrame:
        return graph.degrees(self.links(), self.files())

    def hubs(self, n: int = 12) -> DataFrame:
        return graph.hubs(self.links(), n, self.files())

    def impact(self, file: str) -> DataFrame:
        return graph.impact_summary(self.links(), self.files(), file)

    def blast_radius(self) -> DataFrame:
        return graph.blast_radius(graph.between(self.links(), self.files(), graph.app(), ("source",)))

    def clusters(self) -> DataFrame:
        return chains.module_clusters(graph.between(self.links(), self.files(), graph.app()))

    def chains(self) -> DataFrame:
        entries = rules.entry_points(self.files().filter("file_class = 'app'")).filter("category = 'runtime'")
        return chains.dependency_chains(graph.between(self.links(), self.files(), graph.app()), entries.select(F.col("path").alias("start")))

    def cycles(self) -> DataFrame:
        return chains.circular_pairs(self.links(), files=self.files())

    def focus(self, file: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.focused_graph(self.links(), file)

    def stats(self) -> DataFrame:
        return graph.graph_stats(self.links(), self.files(), merged=True)

    def findings(self, family: str) -> DataFrame:
        """integration, global_state or data_model findings of application files."""
        app = self.files().filter("file_class = 'app'")
        return {"integration": rules.integrations, "global_state": rules.global_state, "data_model": symbols.data_models}[family](app)

    def entry_points(self) -> DataFrame:
        return rules.entry_points(self.files().filter("file_class = 'app'")).orderBy(*rules.entry_order())

    def symbols(self) -> DataFrame:
        return symbols.symbols(self.files())

    def report(self, kind: str, generated_at: str = "") -> DataFrame:
        return report.build(kind, self.files(), self.links(), generated_at, self.root)

    def fingerprint(self) -> DataFrame:
        return text.fingerprint(self.files().select("path", F.col("mtime").cast("long").alias("mtime"), "size"))

    def build_kb(self, folder: str, generated_at: str = "") -> list[str]:
        """Write the three reports and the fingerprint below an existing folder; nothing where there is none."""
        if not _exists(self.spark, folder):
            return []
        written = []
        for kind in report.BUDGETS:
            report.write(self.report(kind, generated_at), os.path.join(folder, kind))
            written.append(kind)
        if {"mtime", "size"} <= set(self.files().columns):
            text.write_state(self.fingerprint(), os.path.join(folder, "fingerprint"), generated_at)
        return written


def _exists(spark: SparkSession, folder: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
