"""Mixing sources to target weights by Efraimidis-Spirakis sampling, all in SQL functions.

Each document gets the exponential key -ln(u) / w, with u from a hash of its id
and w its quality weight; the smallest keys are the sample. A source's target
first takes complete epochs of the source, then the documents of the smallest
keys up to the rest. The prefix sums run in two levels: sums for narrow ranges of
keys (about BUCKET_ROWS documents each, so a hot source has more ranges, and larger
ones only beyond MOST_RANGES of them), and rows only in the one range that the rest ends in. The outcome
is one row for each source, the last key that is taken; a document compares its
own key with it.

Targets are a window over one row for each source. Null text: size 0. Texts are whole,
whatever their length. Null source: a source of its own, last in order. An empty table
gives no rows. Rows that
repeat an id and text share what is left when the budget ends at them. Extra
columns are kept by ``mix_copies`` and ignored by ``mix_sources``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized_join

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents of a key range, and ranges of a source: both windows stay small.
BUCKET_ROWS, MOST_RANGES = 2000, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def default_quality(text: Column, size: Column) -> Column:
    """In (0, 1]: highest where a word and the gap after it take six characters on average."""
    return F.when(size > 0, 1.0 / (1.0 + F.abs(F.length(text) / size - 6.0) / 6.0)).otherwise(1.0)


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: Column | None) -> DataFrame:
    """docs with __size, __source and __ord, the struct that orders a source's documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.withColumn("__size", F.regexp_count(text, F.lit(WORD)).cast("long"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    w = default_quality(text, F.col("__size")) if quality is None else quality
    key = F.struct((-F.log(u) / w).alias("key"), name.alias("id"), F.col("__size").alias("size"), F.xxhash64(text).alias("tie"))
    return sized.withColumn("__ord", key).withColumn("__source", F.col(source_col).cast("string"))


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, n_rows, target) from rows (source, size): one row for each source.

    Weighted shares of share * all sizes; no target above cap * the source's size,
    the excess goes to the others by weight (filled in the order of cap / weight).
    """
    src = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    src = src.withColumn("all_rows", F.lit(1))
    every = Window.partitionBy("all_rows")
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    src = src.withColumn("top", F.col("source_size") * float(cap)).withColumn("r", F.col("top") / F.col("w"))
    by = every.orderBy("r", F.col("source").asc_nulls_last())
    src = src.withColumn("rank", F.row_number().over(by))
    filled = F.coalesce(F.sum("top").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    src = src.withColumn("level", (F.sum("source_size").over(every) * float(share) - filled) / open_w)
    first = F.min(F.when(F.col("level") <= F.col("r"), F.col("rank"))).over(every)
    src = src.withColumn("first", first)
    level = F.max(F.when(F.col("rank") == F.col("first"), F.col("level"))).over(every)
    src = src.withColumn("target", F.when(F.col("rank") < F.coalesce("first", F.col("rank") + 1), F.col("top")).otherwise(level * F.col("w")))
    return src.select("source", "source_size", "n_rows", "target")


def mixing_plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row for each source: target, epochs, and the last order key taken after them.

    ``rows``: (source, size, ord), read several times, so a written table.
    """
    src = source_targets(rows, weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    src = src.withColumn("epochs", whole).withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size"))
    src = materialize(src, "mix-src")
    n = src.count()
    scale = F.greatest(F.lit(1.0), F.least(F.col("n_rows") / float(BUCKET_ROWS), F.lit(float(MOST_RANGES))))
    bucket = F.least(F.col("ord.key") * scale, F.lit(1e15)).cast("long")
    same = lambda l, r: l["source"].eqNullSafe(r["source"])
    s2 = src.select(F.col("source").alias("s"), "n_rows")
    joined = sized_join(rows, s2, rows["source"].eqNullSafe(s2["s"]), rows=n).withColumn("bucket", bucket).drop("s", "n_rows")
    sums = joined.groupBy("source", "bucket").agg(F.sum("size").alias("b_size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("b_size").over(upto))
    s3 = src.select(F.col("source").alias("s"), "rest")
    ends = sized_join(sums, s3, sums["source"].eqNullSafe(s3["s"]), rows=n).filter(F.col("upto") > F.col("rest"))
    ends = ends.groupBy("source", "rest").agg(F.min("bucket").alias("end_bucket"), F.min_by(F.col("upto") - F.col("b_size"), "bucket").alias("before"))
    ends = materialize(ends, "mix-ends")
    e = ends.select(F.col("source").alias("s"), "rest", "end_bucket", "before")
    last = sized_join(joined, e, (joined["source"].eqNullSafe(e["s"])) & (joined["bucket"] == e["end_bucket"]), rows=n).drop("s")
    prior = Window.partitionBy("source").orderBy("ord").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.groupBy("source", "rest", "before", "ord").agg(F.count("*").alias("ties"), F.sum("size").alias("t_size"))
    last = last.withColumn("done", F.col("before") + F.sum("t_size").over(prior) - F.col("t_size"))
    last = last.filter(F.col("done") + F.col("t_size") > F.col("rest"))
    last = last.groupBy("source").agg(F.min("ord").alias("end"), F.min_by(F.floor((F.col("rest") - F.col("done")) / F.col("ties")).cast("long"), "ord").alias("part"))
    out = src.join(last.withColumnRenamed("source", "s"), src["source"].eqNullSafe(F.col("s")), "left").drop("s")
    return materialize(out, "mix-plan")


def _taken() -> Column:
    extra = F.when(F.col("end").isNull(), F.col("size")).when(F.col("ord") < F.col("end"), F.col("size")).when(F.col("ord") == F.col("end"), F.col("part")).otherwise(0)
    extra = F.when(F.col("rest") > 0, extra).otherwise(0)
    return (F.col("epochs") * F.col("size") + extra).cast("long")


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", quality: Column | None = None, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(id, size, source_size, target, taken) for each row."""
    keyed = _keyed(docs, id_col, text_col, source_col, quality)
    rows = materialize(keyed.select(F.col(id_col).alias("id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__ord").alias("ord")), "mix-rows")
    plan = mixing_plan(rows.select("source", "size", "ord"), weights, share, cap)
    p = plan.withColumnRenamed("source", "s")
    joined = sized_join(rows, p, rows["source"].eqNullSafe(p["s"]))
    return joined.select("id", "size", "source_size", "target", _taken().alias("taken"))


def mix_copies(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", quality: Column | None = None, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """docs as the mix has them: a row for each started copy; what the mix doesn't take goes.

    A document without words costs the mix nothing and stays once.
    """
    keyed = _keyed(docs, id_col, text_col, source_col, quality)
    rows = materialize(keyed.select(F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__ord").alias("ord")), "mix-rows")
    plan = mixing_plan(rows, weights, share, cap)
    p = plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns])
    joined = sized_join(keyed, p, keyed["__source"].eqNullSafe(p["__p_source"]))
    swap = {"end": "__p_end", "size": "__size", "ord": "__ord", "part": "__p_part", "rest": "__p_rest", "epochs": "__p_epochs"}
    c = {k: F.col(v) for k, v in swap.items()}
    extra = F.when(c["end"].isNull() | (c["ord"] < c["end"]), c["size"]).when(c["ord"] == c["end"], c["part"]).otherwise(0)
    taken = c["epochs"] * c["size"] + F.when(c["rest"] > 0, extra).otherwise(0)
    copies = F.when(c["size"] == 0, 1).otherwise(F.ceil(taken / c["size"])).cast("int")
    return joined.withColumn("__n", copies).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all documents mixed to 150 % of their size, sources weighing 3, 1, 2."""
    out = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT *, -ln((('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(length(text)::DOUBLE / size - 6.0::DOUBLE) / 6.0::DOUBLE) ELSE 1.0 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((i - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS top FROM s),
r AS (
  SELECT *, row_number() OVER o AS rank, top / w AS r,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(top) OVER (ORDER BY top / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY top / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY top / w, i)),
f AS (SELECT min(rank) AS first, min_by(level, rank) AS level FROM r WHERE level <= r),
t AS (SELECT source, source_size, CASE WHEN rank < f.first THEN top ELSE f.level * w END AS target FROM r, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
g AS (SELECT *, floor(target + 0.5)::BIGINT - epochs * source_size AS rest FROM e),
c AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM c
"""
