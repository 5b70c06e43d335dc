"""Frameworks, layers, tests and the symbol index's order, from paths and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.state import by_key
from .graph import degrees


def _present(files: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: whether any file has each flag; false where there are no files."""
    return files.agg(*[F.coalesce(F.bool_or(on), F.lit(False)).alias(name) for name, on in flags.items()])


def _named(row: DataFrame, names: dict[str, Column]) -> DataFrame:
    all_of = F.array(*[F.when(on, name) for name, on in names.items()])
    return row.select(F.explode(F.filter(all_of, lambda x: x.isNotNull())).alias("name"))


def frameworks(files: DataFrame) -> DataFrame:
    """(name) of the frameworks that names and folders of files (path) hint at."""
    low = F.lower("path")
    name = F.regexp_extract(low, r"[^/]*$", 0)
    c, n, folder = F.col, lambda *x: name.isin(*x), lambda *x: low.rlike("/(" + "|".join(x) + ")/")
    row = _present(files, {
        "fastapi": name.contains("fastapi") | folder("api", "routes"), "react": name.rlike(r"\.(tsx|jsx)$") | folder("components"), "next": folder("pages", "app"),
        "models": n("models.py"), "views": n("views.py"), "urls": n("urls.py"), "settings": n("settings.py"), "manage": n("manage.py"),
        "java": name.endswith(".java"), "application": name.endswith(".java") & name.contains("application"), "controller": folder("controllers?"), "service": folder("services?"),
        "cs": name.endswith(".cs"), "program": n("program.cs", "startup.cs"), "controllers": folder("controllers")})
    return _named(row, {
        "FastAPI": c("fastapi"), "React": c("react"), "Next.js": c("next"),
        "Django": c("manage") & (c("settings") | c("urls")) | c("models") & (c("views") | c("urls")),
        "Spring Boot": c("java") & (c("application") | c("controller") & c("service")), "ASP.NET Core": c("cs") & (c("program") | c("controllers"))})


def layer_flows(files: DataFrame) -> DataFrame:
    """(name) of the flows whose layers the paths show."""
    low, c = F.lower("path"), F.col
    row = _present(files, {
        "models": low.contains("model"), "services": low.contains("service"), "handlers": low.rlike("handler|controller"), "api": low.rlike("/api/|route"),
        "components": low.contains("component"), "hooks": low.contains("hook") | F.col("path").contains("use")})
    return _named(row, {"API request flow": c("api") & c("handlers"), "Data flow": c("models") & c("services"), "React data flow": c("components") & c("hooks")})


def test_organisation(files: DataFrame) -> DataFrame:
    """(dir, files) of folders with test or spec files."""
    hit = F.lower("stem").rlike("test|spec")
    return files.filter(hit).groupBy("dir").agg(F.count("*").alias("files"))


# Names of test files by pattern.
TEST_STYLES = (("*.test.*", r"\.test\."), ("*.spec.*", r"\.spec\."), ("test_*", r"^test_"))


def test_styles(files: DataFrame) -> DataFrame:
    """(style, files): how test files are named."""
    hits = F.array(*[F.when(F.lower("basename").rlike(p), name) for name, p in TEST_STYLES])
    return files.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("style")).groupBy("style").agg(F.count("*").alias("files"))


def test_summary(files: DataFrame) -> DataFrame:
    """One line (n, text) on the test files and their first two folders, none without test files.

    Files of the class test are looked at, all files where there are none of it.
    """
    some = files.agg(F.coalesce(F.max(F.col("file_class") == "test"), F.lit(False)).alias("some"))
    own = test_organisation(files.join(F.broadcast(some)).filter("not some or file_class = 'test'"))
    name = F.when(F.lower("dir").contains("test"), F.regexp_extract("dir", r"[^/]*$", 0))
    named = own.select(name.alias("d")).filter("d is not null").distinct().orderBy("d").limit(2).agg(F.array_sort(F.collect_list("d")).alias("dirs"))
    row = own.agg(F.sum("files").alias("files")).filter("files > 0").join(F.broadcast(named))
    text = F.concat(F.lit("Test files: "), F.col("files").cast("string"), F.when(F.size("dirs") > 0, F.concat(F.lit(" | Folders: "), F.array_join("dirs", ", "))).otherwise(""))
    return row.select(F.lit(1).cast("long").alias("n"), text.alias("text"))


def symbol_index(files: DataFrame, edges: DataFrame, findings: DataFrame, n: int = 40) -> DataFrame:
    """(file, score) of the n best files: 2 * in + out, 25 for a finding (file), -10 for a test; no third party."""
    f = files.filter("file_class <> 'third_party'").select(F.col("path").alias("file"), (F.col("file_class") == "test").alias("test"))
    hit = findings.select("file").distinct().withColumn("hit", F.lit(True))
    all_of = f.join(by_key(degrees(edges)), "file", "left").join(by_key(hit), "file", "left").na.fill(0, ["in_degree", "out_degree"])
    score = 2 * F.col("in_degree") + F.col("out_degree") + F.when(F.col("hit"), 25).otherwise(0) - F.when(F.col("test"), 10).otherwise(0)
    return all_of.select("file", score.cast("long").alias("score")).orderBy(F.desc("score"), "file").limit(n)
