"""Views of relational tables as edges, source files and change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scan import with_parts

#: Each statement runs on Spark and on DuckDB.
EDGES_SUPP_PART = "SELECT DISTINCT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target, 'import' AS type, 0.75 AS strength FROM lineitem"
EDGES_ORDER_PART = "SELECT DISTINCT concat('o', l_orderkey) AS source, concat('p', l_partkey) AS target, 'import' AS type, 0.75 AS strength FROM lineitem"
EDGES_USER_NEXT = """SELECT DISTINCT source, target, 'import' AS type, CAST(0.75 AS DOUBLE) AS strength FROM (
  SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS source, user_id AS target FROM events) x WHERE source <> target"""
_NL = "chr(10)"
SOURCE_FILES = f"""SELECT concat('/w/', dir, '/', stem, ext) AS path,
  CASE ext
    WHEN '.py' THEN concat('from mod', k + 35, ' import a, b as c', {_NL}, 'import pkg.mod', k + 70, {_NL}, 'CACHE = dict()', {_NL}, 'requests.get(url)', {_NL}, 'self.run(x)')
    WHEN '.ts' THEN concat('import D, {{ x as y, z }} from ''./mod', k + 35, '''', {_NL}, 'import ''side', k, '''', {_NL}, 'axios.post(u)', {_NL}, 'let a = new Map()')
    WHEN '.java' THEN concat('import com.x.Mod', k, ';', {_NL}, 'import static com.y.*;', {_NL}, 'Foo.getInstance();')
    WHEN '.cs' THEN concat('using A = B.C', k, ';', {_NL}, 'using static X.Y;', {_NL}, 'using System.Text;')
    ELSE concat('import "a/b', k, '"', {_NL}, 'x "c/d"', {_NL}, 'call(1)') END AS content
FROM (SELECT p_partkey AS k, concat('mod', p_partkey) AS stem,
    CASE p_partkey % 7 WHEN 0 THEN 'app' WHEN 1 THEN 'src/core' WHEN 2 THEN 'tests' WHEN 3 THEN 'node_modules/x' WHEN 4 THEN 'lib/util' WHEN 5 THEN 'db/migrations' ELSE 'src/config' END AS dir,
    CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java' WHEN 3 THEN '.cs' ELSE '.go' END AS ext
  FROM part) p"""

#: Files with definitions, a few kinds by language.
CODE_FILES = f"""SELECT concat('/w/', dir, '/f', k, ext) AS path,
  CASE ext
    WHEN '.py' THEN concat('@dataclass', {_NL}, 'class D', k, ':', {_NL}, '    x: int', {_NL}, '    y: int', {_NL}, 'class M', k, '(BaseModel):', {_NL}, '    tag: str', {_NL}, 'def get_item(a, b):', {_NL}, '    pass')
    WHEN '.ts' THEN concat('export interface I', k, ' {{', {_NL}, '  id: number;', {_NL}, '  tag: string;', {_NL}, '}}', {_NL}, 'export function handleReq(a, b) {{}}')
    WHEN '.java' THEN concat('public record R', k, '(int a, int b) {{}}', {_NL}, 'public class C', k, ' extends Base {{', {_NL}, '  public int getAll(int n) {{ return n; }}', {_NL}, '}}')
    ELSE concat('func Run', k, '(a int) {{}}') END AS content
FROM (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'model' ELSE 'tests' END AS dir,
    CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.java' ELSE '.go' END AS ext FROM part) p"""


def view(spark: SparkSession, sf_dir: str, sql: str, table: str, deal: str | None = None) -> DataFrame:
    """The statement over one table of a folder; with ``deal`` its rows are dealt to tasks by that column first."""
    escaped = sql.replace("{", "{{").replace("}", "}}")
    src = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if deal:
        src = src.select(deal).repartition(deal)
    return spark.sql(escaped.replace(f"FROM {table}", "FROM {src}"), src=src)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a million keys are one small file, the texts made of them are work for all tasks
    return with_parts(view(spark, sf_dir, SOURCE_FILES, "part", "p_partkey"), "/w")


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_parts(view(spark, sf_dir, CODE_FILES, "part", "p_partkey"), "/w")


def user_next(events: DataFrame) -> DataFrame:
    """EDGES_USER_NEXT without one task that sorts all events.

    Each minute's events are ordered by a task; the first of a minute follows the last of
    the minute before it that has any, which is found among one row for each minute.
    """
    e = events.filter("ts is not null").select(F.date_trunc("minute", "ts").alias("minute"), "ts", "event_id", "user_id")
    last = e.groupBy("minute").agg(F.max_by("user_id", F.struct("ts", "event_id")).alias("last"))
    before = last.select("minute", F.lag("last").over(Window.orderBy("minute")).alias("before"))
    own = F.lag(F.struct("user_id")).over(Window.partitionBy("minute").orderBy("ts", "event_id"))
    out = e.withColumn("own", own).join(before, "minute")
    out = out.select(F.when(F.col("own").isNull(), F.col("before")).otherwise(F.col("own.user_id")).alias("source"), F.col("user_id").alias("target"))
    return out.filter("source <> target").select("source", "target", F.lit("import").alias("type"), F.lit(0.75).alias("strength")).distinct()
