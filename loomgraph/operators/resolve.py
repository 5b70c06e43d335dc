"""Module names to files: candidate keys with priorities, one join, the best rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..plans.state import by_key
from .extract import strength

SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
KNOWN = r"\.(py|tsx?|jsx?|mjs|cjs|java|cs|go)$"


def family(ext: Column) -> Column:
    return F.when(ext.isin(*SCRIPT), "script").otherwise(ext)


def file_index(files: DataFrame) -> DataFrame:
    """(kind, key, target, t_ext, t_dir): path, base (stem) and package (path suffix) keys, lower case."""
    f = files.select("path").withColumn("t_ext", P.extension(F.col("path"))).withColumn("t_dir", P.dirname(F.col("path")))
    full = F.filter(F.split(F.regexp_replace(F.lower("path"), r"\.[^./]*$", ""), "/"), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(full)), lambda n: F.array_join(F.slice(full, -n, n), "/"))
    keys = F.concat(F.array(F.struct(F.lit("path").alias("kind"), F.lower("path").alias("key")), F.struct(F.lit("base").alias("kind"), F.lower(P.stem(F.col("path"))).alias("key"))), F.transform(suffixes, lambda s: F.struct(F.lit("package").alias("kind"), s.alias("key"))))
    return f.select(F.col("path").alias("target"), "t_ext", "t_dir", F.explode(keys).alias("k")).select("k.kind", "k.key", "target", "t_ext", "t_dir")


def _candidates() -> Column:
    m, ext, here = F.col("module"), F.col("ext"), F.col("dir")
    dotted = m.contains(".")
    variants = F.when(dotted, F.array(m, F.element_at(F.split(m, r"\."), -1), F.replace(m, F.lit("."), F.lit("/")))).otherwise(F.array(m))

    def files_of(v: Column) -> Column:
        many = lambda ends: F.array(*[F.concat(v, F.lit(e)) for e in ends])
        return (F.when(ext == ".py", many((".py", "/__init__.py"))).when(ext.isin(*SCRIPT), many((*SCRIPT, "/index.ts", "/index.tsx", "/index.js", "/index.jsx")))
                .when(ext == ".go", F.array(F.concat(v, F.lit(".go")), F.concat(F.lit("pkg.go")), F.concat(v, F.lit("/pkg.go")))).otherwise(F.array(F.concat(v, ext), F.concat(v, F.lit("/index"), ext))))

    key = lambda stage, i, j, kind, k: F.struct(F.lit(stage).alias("stage"), i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), F.lower(k).alias("key"))
    rel = F.flatten(F.transform(variants, lambda v, i: F.transform(files_of(v), lambda c, j: key(1, i, j, "path", P.resolve(here, c)))))
    base = F.transform(variants, lambda v, i: key(2, i, F.lit(0), "base", P.basename(v)))
    slashed = F.array(F.replace(m, F.lit("."), F.lit("/")))
    inner = F.filter(variants, lambda v: v.contains("/") & ~v.startswith("."))
    scoped = F.when(m.startswith("@"), F.array(F.substr(m, F.lit(2)), F.regexp_replace(m, r"^@[^/]*/", ""))).otherwise(F.array().cast("array<string>"))
    packages = F.transform(F.array_distinct(F.concat(slashed, inner, scoped)), lambda v, i: key(3, i, F.lit(0), "package", F.regexp_replace(F.regexp_replace(v, "^/", ""), KNOWN, "")))
    return F.concat(rel, base, packages)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with their target file; those without one go."""
    rows = imports.withColumn("dir", P.dirname(F.col("path"))).withColumn("c", F.explode(_candidates())).select("*", "c.*").drop("c")
    hits = rows.join(by_key(file_index(files)), ["kind", "key"])
    hits = hits.filter((F.col("stage") == 1) | (family(F.col("ext")) == family(F.col("t_ext"))))
    same = F.col("dir") == F.col("t_dir")
    apart = F.size(F.array_except(F.split("t_dir", "/"), F.split("dir", "/"))) + F.size(F.array_except(F.split("dir", "/"), F.split("t_dir", "/")))
    late = F.col("stage") > 1
    order = ["stage", "i", "j", F.when(late, ~same), F.when(late & ~same, F.col("ext") != F.col("t_ext")), F.when(late & ~same, apart), "target"]
    best = F.row_number().over(Window.partitionBy("path", "ord").orderBy(*order))
    return hits.withColumn("best", best).filter("best = 1").select("path", "target", "module", "symbols", "is_default", "line_no", "ord")


def links(resolved: DataFrame) -> DataFrame:
    """(source, target, type, strength, symbols, lines): one import link for each pair of files."""
    r = resolved.filter("path <> target").withColumn("s", strength(F.col("symbols"), F.col("is_default")))
    out = r.groupBy(F.col("path").alias("source"), "target").agg(
        F.max("s").alias("strength"), F.array_sort(F.collect_list(F.struct("ord", "symbols"))).alias("parts"), F.array_sort(F.collect_set("line_no")).alias("lines"))
    return out.select("source", "target", F.lit("import").alias("type"), "strength", F.array_distinct(F.flatten("parts.symbols")).alias("symbols"), "lines")


def call_links(calls: DataFrame, files: DataFrame, qualified: bool = False) -> DataFrame:
    """(source, target, type, strength, symbols, lines): call links, 0.6 and 0.1 more for each further call, 1 at most.

    A bare callee names no module, so by itself it gives no link: without ``qualified``
    there are none. With it a call ``x.y(...)`` links to the files named x that contain y.
    Calls: path, line_no, callee, name.
    """
    c = calls.filter("is_external").withColumn("module", F.lower(F.element_at(F.split("name", r"\."), -2))).filter(F.lit(qualified))
    index = file_index(files).filter("kind = 'base'").select(F.col("key").alias("module"), "target")
    hits = c.join(by_key(index), "module").filter("path <> target").join(by_key(files.select(F.col("path").alias("target"), "content")), "target").filter(F.col("content").contains(F.col("callee")))
    out = hits.groupBy(F.col("path").alias("source"), "target").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("callee")).alias("symbols"), F.array_sort(F.collect_set("line_no")).alias("lines"))
    return out.select("source", "target", F.lit("call").alias("type"), F.round(F.least(F.lit(1.0), 0.6 + 0.1 * (F.col("n") - 1)), 6).alias("strength"), "symbols", "lines")


def in_order(links: DataFrame) -> DataFrame:
    """Links by source, target and type in the order of a dictionary (upper and lower case side by side)."""
    return links.orderBy(*[F.collate(F.col(c), "UNICODE") for c in ("source", "target", "type")])
