"""File scans to source_files rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import text
from . import ignore

# The extensions that are scanned.
EXTENSIONS = ("py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "cpp", "c", "hpp", "h", "cs", "go", "rs", "rb", "php")
# Fixed values: (id, file or folder at the root) of the assistants that are looked for.
ASSISTANTS = (("copilot", ".github/copilot-instructions.md"), ("cursor", ".cursor"), ("cursor", ".cursorrules"), ("claude", "CLAUDE.md"), ("other", "AGENTS.md"))


def with_parts(files: DataFrame, root: str) -> DataFrame:
    """files (path, content, ...) with rel, dir, basename, stem, ext and file_class."""
    p = F.col("path")
    out = files.withColumn("rel", P.relative(p, root)).withColumn("dir", P.dirname(p)).withColumn("basename", P.basename(p))
    return out.withColumn("stem", P.stem(p)).withColumn("ext", P.extension(p)).withColumn("file_class", P.file_class(F.col("rel")))


def first_paths(files: DataFrame, most: int, by_extension: bool = True) -> DataFrame:
    """(path) of the ``most`` smallest paths, of each extension or of all: ordered limits, so no task sorts all paths."""
    paths = files.select("path", "ext")
    parts = [paths.filter(F.col("ext") == f".{e}") for e in EXTENSIONS] if by_extension else [paths]
    return reduce(DataFrame.union, [p.select("path").orderBy("path").limit(most) for p in parts])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(rel) of all files below root, from which markers are looked up; no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)
    return raw.select(P.relative(_local(F.col("path")), root).alias("rel"))


def _local(path: Column) -> Column:
    return F.regexp_replace(path, r"^file:/*(?=/)", "")


def excluded_names(spark: SparkSession, root: str, always=(), never=(), profile: str = "standard", markers: bool = True) -> list[str]:
    """Folder names that a scan leaves out: always, by name, by markers at the root; none of ``never``."""
    if markers:
        return ignore.excluded_dirs(listing(spark, root), P.PROFILES[profile], always, never)
    return [d for d in dict.fromkeys([*always, *P.PROFILES[profile]]) if d not in never]


def scan(spark: SparkSession, root: str, never=(), content: bool = True, profile: str = "standard", most: int | None = None, by_extension: bool = True, always=(), settings=(), markers: bool = False) -> DataFrame:
    """source_files below root: known extensions, no excluded folder, no empty content.

    Folders are filtered on the path before content is touched; without ``content``
    the column is never read. The ``broad`` profile also excludes build, environment
    and test-output folders by name. ``most`` keeps only the first paths of each
    extension (or of all), chosen from a listing without content. ``always`` and
    ``never`` add and take away folder names, ``markers`` adds the folders at the root
    that marker files tell (one pass over the listing), ``settings`` are an editor's
    exclude patterns. Files that vanish or can't be read on the way are left out.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}")
           .option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True).load(root))
    cols = [_local(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime")]
    names = excluded_names(spark, root, always, never, profile, markers)
    # a folder that only a marker or the caller names is one at any depth, as names are
    keep = ~P.is_excluded(F.col("rel"), names=names) & ~P.is_settings_excluded(F.col("path"), list(settings))
    files = raw.select(*cols, *([F.decode("content", "UTF-8").alias("content")] if content else []))
    out = with_parts(files, root).filter(keep).dropDuplicates(["path"])
    if most is not None:
        listed = with_parts(raw.select(*cols), root).filter(keep).dropDuplicates(["path"])
        out = out.join(first_paths(listed, most, by_extension), "path", "left_semi")
    return out.filter("content <> ''") if content else out


def snapshot(files: DataFrame) -> DataFrame:
    """One row (fingerprint, files) of which files there are: creating or deleting one changes it, editing one doesn't."""
    return text.fingerprint(files.select("path", F.lit(0).alias("mtime"), F.lit(0).alias("size")))


class ScanCache:
    """Scans kept by root until a file is created or deleted (``dirty``); edits keep them."""

    def __init__(self, spark: SparkSession, **options):
        self.spark, self.options, self.kept = spark, options, {}

    def files(self, root: str) -> DataFrame:
        if root not in self.kept:
            self.kept[root] = scan(self.spark, root, **self.options).persist()
        return self.kept[root]

    def dirty(self, root: str) -> None:
        if (old := self.kept.pop(root, None)) is not None:
            old.unpersist()


def assistants(listing: DataFrame, probes=ASSISTANTS) -> DataFrame:
    """(id): the assistants of whose probes a file or folder is in the listing (rel), in one pass over it."""
    hits = [F.when((F.col("rel") == p) | F.col("rel").startswith(p + "/"), name) for name, p in probes]
    return listing.select(F.explode(F.array_compact(F.array(*hits))).alias("id")).distinct()
