"""Fingerprints and size-bounded reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(text: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def fingerprint(files: DataFrame, buckets: int = 1024) -> DataFrame:
    """One row (fingerprint, files) of rows (path, mtime, size), whatever their order.

    Rows are digested in buckets of their path's hash and the buckets' digests in
    order, so no task has all rows.
    """
    row = F.concat_ws(":", "path", F.col("mtime").cast("string"), F.col("size").cast("string"))
    part = files.select(F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("b"), row.alias("r"))
    each = part.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("r")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    one = each.agg(F.array_sort(F.collect_list(F.struct("b", "d"))).alias("all"), F.sum("n").alias("files"))
    return one.select(digest(F.array_join(F.transform("all", lambda x: x["d"]), "\n")).alias("fingerprint"), F.coalesce("files", F.lit(0)).alias("files"))


def line_budget(report: DataFrame, most: int) -> DataFrame:
    """report_lines (report, ord, text) of at most ``most`` lines a report.

    A longer one ends before the last heading or rule within the 13 lines before
    most - 4, else there, then a blank, the number of omitted lines, a blank and a close.
    """
    w = Window.partitionBy("report")
    r = report.withColumn("n", F.row_number().over(w.orderBy("ord"))).withColumn("total", F.count("*").over(w))
    limit = most - 4
    mark = (F.col("text").startswith("##") | (F.col("text") == "---")) & (F.col("n") > limit - 13) & (F.col("n") <= limit)
    r = r.withColumn("cut", F.when(F.col("total") <= most, F.col("total")).otherwise(F.coalesce(F.max(F.when(mark, F.col("n") - 1)).over(w), F.lit(limit))))
    kept = r.filter("n <= cut").select("report", F.col("n").alias("ord"), "text")
    tail = r.filter("n = 1 and total > cut").select("report", "cut", F.posexplode(F.array(F.lit(""), F.concat((F.col("total") - F.col("cut")).cast("string"), F.lit(" lines omitted")), F.lit(""), F.lit("end"))).alias("i", "text"))
    return kept.unionByName(tail.select("report", (F.col("cut") + 1 + F.col("i")).alias("ord"), "text"))


VERSION = "0.1.0"


def write_state(current: DataFrame, folder: str, generated_at: str = "") -> None:
    """Keep a fingerprint's one row as JSON."""
    current.withColumn("version", F.lit(VERSION)).withColumn("generated_at", F.lit(generated_at)).coalesce(1).write.mode("overwrite").json(folder)


def is_stale(current: DataFrame, folder: str) -> bool:
    """No record, another version or another fingerprint."""
    from pyspark.errors import AnalysisException

    try:
        kept = current.sparkSession.read.schema("fingerprint string, version string").json(folder).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = None
    return kept is None or kept.version != VERSION or kept.fingerprint != current.first().fingerprint


START, END = "<!-- loomgraph:start -->", "<!-- loomgraph:end -->"


def merge_section(text: Column, section: Column, start: str = START, end: str = END) -> Column:
    """text with what stands between the markers replaced; a section of its own at the end where there are none."""
    at, to = F.instr(text, start), F.instr(text, end)
    inside = F.concat(F.substring(text, 1, at - 1 + len(start)), F.lit("\n"), section, F.lit("\n"), F.substr(text, to))
    gap = F.when(F.regexp_replace(text, r"\s", "") != "", "\n\n").otherwise("")
    return F.when((at > 0) & (to > at), inside).otherwise(F.concat(text, gap, F.lit(start + "\n"), section, F.lit("\n" + end + "\n")))


def remove_section(text: Column, start: str = START, end: str = END) -> Column:
    """text without the markers, what is between them, the line ends after them and one before them."""
    return F.regexp_replace(text, rf"(?s)[\r\n]?{start}.*?{end}[\r\n]*", "")
