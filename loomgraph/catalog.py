"""Registered queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import catalog_workspace, engine
from .functions import paths as P
from .operators import chains, conventions, extract, graph, report, resolve, rules, symbols, text
from .plans import bindings as B
from .plans.state import ensure_checkpoints
from .sources import ignore
from .streaming import changes

supp = lambda s, d: B.view(s, d, B.EDGES_SUPP_PART, "lineitem")
order = lambda s, d: B.view(s, d, B.EDGES_ORDER_PART, "lineitem")
files = B.source_files
code = B.code_files


def users(s, d):
    ensure_checkpoints(s)
    return B.user_next(s.read.parquet(f"{d}/events.parquet"))


def _lines(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.lit("").alias("ext"), F.col("text").alias("content"))
    out = extract.lines(docs)
    return out.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("trimmed")).alias("trimmed_chars"))


def _fingerprint(s, d):
    part = s.read.parquet(f"{d}/part.parquet")
    return part.select(text.digest(F.concat_ws(":", F.col("p_name"), F.col("p_size").cast("string"))).alias("digest"), F.col("p_partkey").alias("p_partkey"))


def _imports(s, d):
    out = extract.imports(files(s, d))
    return out.select("path", "module", F.array_join("symbols", "|").alias("symbols"), "is_default", F.col("line_no").cast("long").alias("line_no"))


def _debounce(s, d):
    out = changes.debounce(s.read.parquet(f"{d}/events.parquet"), "user_id", gap="30 minutes")
    return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


def _hrefs(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("links"))


def _budget(s, d):
    talks = s.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("report"), F.col("turn").alias("ord"), "text")
    return text.line_budget(talks, 6)


def _links(s, d):
    f = files(s, d)
    out = resolve.links(resolve.resolve_imports(extract.imports(f), f))
    return out.select("source", "target", "strength", F.array_join("symbols", "|").alias("symbols"))


def _scalars(s, d):
    rel = F.col("rel")
    return files(s, d).select("path", "ext", "stem", "file_class", P.short_path(F.col("path")).alias("short"), P.module_name(rel).alias("module"), P.is_excluded(rel).alias("excluded"))


def _ignored(s, d):
    return files(s, d).select("path", ignore.is_ignored(F.col("rel"), ["# rules", "lib/", "*.java", "!src/**/*.java", "app"]).alias("ignored"))


def _chains(s, d):
    out = chains.dependency_chains(users(s, d))
    return out.select(F.array_join("chain", ">").alias("chain"), F.col("depth").cast("long").alias("depth"), "start_path", "starts_from_entry")


def _circular(s, d):
    return chains.circular_pairs(graph.mark_circular(users(s, d)))


def _cycle_count(s, d):
    return chains.cycle_count(graph.mark_circular(users(s, d)))


def _symbol_index(s, d):
    f = files(s, d)
    return conventions.symbol_index(f, resolve.links(resolve.resolve_imports(extract.imports(f), f)), rules.integrations(f))


def _report(kind, view=files):
    def query(s, d):
        f = view(s, d)
        return report.build(kind, f, engine.link_files(f), "0", "/w")
    return query


def _walk_sql(hops: int) -> str:
    """CTEs w0..w<hops> over l and the starts s(start)."""
    out = ["w0 AS (SELECT start, [start] AS chain FROM s)"]
    for i in range(hops):
        out.append(f"n{i} AS (SELECT start, min(target) AS t FROM w{i} JOIN l ON l.source = chain[-1] WHERE len(chain) = {i + 1} AND NOT list_contains(chain, target) GROUP BY start), w{i + 1} AS (SELECT start, CASE WHEN t IS NULL THEN chain ELSE list_append(chain, t) END AS chain FROM w{i} LEFT JOIN n{i} USING (start))")
    return ", ".join(out)


_E = f"e AS ({B.EDGES_SUPP_PART})"
_U = f"e AS ({B.EDGES_USER_NEXT})"
_D = "d AS (SELECT file, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source AS file, 0 AS i, 1 AS o FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY file)"
_S = f"f AS (SELECT *, regexp_extract(path, '[^/]*$') AS basename, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '(\\.[^.]*)$', 1) AS ext, substr(path, 4) AS rel FROM ({B.SOURCE_FILES}))"
_LOW = "SELECT DISTINCT source, target FROM e WHERE source <> target"

_DEFS = {
    "degrees": (lambda s, d: graph.degrees(supp(s, d)), f"WITH {_E}, {_D} SELECT * FROM d"),
    "hubs": (lambda s, d: graph.hubs(supp(s, d)), f"WITH {_E}, {_D}, h AS (SELECT *, 2 * (in_degree + out_degree) AS score FROM d WHERE in_degree + out_degree > 2) SELECT *, row_number() OVER (ORDER BY score DESC, file) AS rank FROM h ORDER BY score DESC, file LIMIT 12"),
    "hub_risk": (lambda s, d: graph.hub_risk(supp(s, d)), f"WITH {_E} SELECT target AS file, count(DISTINCT source) AS importers, CASE WHEN count(DISTINCT source) > 8 THEN 'High' WHEN count(DISTINCT source) > 4 THEN 'Medium' ELSE 'Low' END AS risk FROM e GROUP BY target"),
    "centrality": (lambda s, d: graph.centrality(supp(s, d)), f"WITH {_E}, {_D} SELECT file, 2 * in_degree + out_degree AS score, in_degree, out_degree FROM d ORDER BY score DESC, file LIMIT 8"),
    "co_import_pairs": (lambda s, d: graph.co_import_pairs(order(s, d)), f"WITH e AS ({B.EDGES_ORDER_PART}) SELECT a.target AS a, b.target AS b, count(*) AS shared FROM e a JOIN e b ON a.source = b.source AND a.target < b.target GROUP BY 1, 2 HAVING count(*) >= 2"),
    "blast_radius": (lambda s, d: graph.blast_radius(users(s, d)), f"""WITH {_U}, l AS ({_LOW}), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) AS n FROM l),
      i AS (SELECT a.target AS file, count(DISTINCT b.source) AS indirect FROM r a JOIN r b ON b.target = a.source AND b.n <= 3 WHERE a.n <= 10 AND b.source <> a.target GROUP BY 1),
      x AS (SELECT target AS file, count(*) AS direct FROM l GROUP BY 1) SELECT file, direct, coalesce(indirect, 0) AS indirect, direct + coalesce(indirect, 0) AS blast FROM x LEFT JOIN i USING (file)"""),
    "merge_reverse": (lambda s, d: graph.merge_reverse(users(s, d)), f"""WITH {_U}, l AS ({_LOW}) SELECT a.source, a.target, 'import' AS type, CASE WHEN b.source IS NULL THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END AS strength, b.source IS NOT NULL AS bidirectional
      FROM l a LEFT JOIN l b ON a.source = b.target AND a.target = b.source WHERE b.source IS NULL OR a.source < a.target"""),
    "impact": (lambda s, d: graph.impact(users(s, d), 1), f"""WITH {_U}, {_D}, x AS (SELECT DISTINCT source AS file FROM e WHERE target = 1 AND source <> 1)
      SELECT x.file AS dependent, in_degree, (SELECT count(*) FROM x) AS dependents, CASE WHEN (SELECT count(*) FROM x) >= 5 THEN 'HIGH' WHEN (SELECT count(*) FROM x) >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM x JOIN d USING (file) ORDER BY in_degree DESC, dependent LIMIT 5"""),
    "focus_metrics": (lambda s, d: graph.focus_metrics(users(s, d), 1), f"""WITH {_U}, n AS (SELECT * FROM e WHERE source = 1 OR target = 1), x AS (SELECT source AS file, 1 AS i, 0 AS x FROM n UNION ALL SELECT target, 0, 1 FROM n)
      SELECT file, sum(i)::BIGINT AS imports, sum(x)::BIGINT AS exports, 0::BIGINT AS calls, count(*) AS total, false AS circular, file = 1 OR count(*) > 5 AS is_hub, count(*) AS importance FROM x GROUP BY file"""),
    "graph_stats": (lambda s, d: graph.graph_stats(users(s, d)), f"WITH RECURSIVE {_U}, l AS ({_LOW}), r AS (SELECT source, target FROM l UNION SELECT r.source, l.target FROM r JOIN l ON l.source = r.target), g AS (SELECT a.source AS n, least(a.source, min(a.target)) AS c FROM r a JOIN r b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.source) SELECT (SELECT count(*) FROM (SELECT source FROM l UNION SELECT target FROM l)) AS files, (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM l a JOIN l b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target) AS two_way, (SELECT count(DISTINCT c) FROM g) AS cycle_groups"),
    "strong_components": (lambda s, d: graph.strong_components(users(s, d)), f"""WITH RECURSIVE {_U}, l AS ({_LOW}), r AS (SELECT source, target FROM l UNION SELECT r.source, l.target FROM r JOIN l ON l.source = r.target),
      m AS (SELECT a.source AS node, least(a.source, min(a.target)) AS component FROM r a JOIN r b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target GROUP BY a.source) SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM m"""),
    "directory_stats": (lambda s, d: graph.directory_stats(files(s, d)), f"WITH {_S} SELECT dir, sum(c)::BIGINT AS files, string_agg(concat(ext, ':', c), ',' ORDER BY ext) AS extensions, CASE regexp_extract(dir, '[^/]*$') WHEN 'tests' THEN 'Tests' WHEN 'config' THEN 'Configuration' ELSE 'General' END AS purpose FROM (SELECT dir, ext, count(*) AS c FROM f GROUP BY 1, 2) GROUP BY dir HAVING sum(c) >= 2 ORDER BY files DESC, dir LIMIT 12"),
    "path_scalars": (_scalars, f"""WITH {_S} SELECT path, ext, regexp_replace(basename, '(.)\\.[^.]*$', '\\1') AS stem, CASE WHEN rel LIKE 'node_modules/%' THEN 'third_party' WHEN rel LIKE 'tests/%' THEN 'test' ELSE 'app' END AS file_class,
      regexp_extract(path, '[^/]*/[^/]*$') AS short, replace(regexp_replace(rel, '\\.py$', ''), '/', '.') AS module, rel LIKE 'node_modules/%' AS excluded FROM f"""),
    "integrations": (lambda s, d: rules.integrations(files(s, d)), f"WITH {_S} SELECT path AS file, 'integration' AS family, CASE ext WHEN '.py' THEN 'HTTP client: requests' ELSE 'HTTP client: axios' END AS message FROM f WHERE regexp_matches(content, 'requests\\.(get|post|put|delete|patch)|axios\\.(get|post|put|delete|patch|request)')"),
    "global_state": (lambda s, d: rules.global_state(files(s, d)), f"WITH {_S} SELECT path AS file, 'global_state' AS family, CASE ext WHEN '.py' THEN 'Module-level mutable state' WHEN '.ts' THEN 'Global mutable state' ELSE 'Singleton pattern' END AS message FROM f WHERE regexp_matches(content, '(?m)^CACHE = dict\\(|^let \\w+ = new Map|getInstance\\(\\)')"),
    "line_explode": (_lines, "SELECT doc_id::VARCHAR AS path, count(*) AS n_lines, sum(length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')))::BIGINT AS trimmed_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1"),
    "page_links": (_hrefs, "SELECT href, count(DISTINCT page_id) AS pages, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY href"),
    "fingerprint": (_fingerprint, "SELECT substr(sha256(concat_ws(':', p_name, p_size::VARCHAR)), 1, 16) AS digest, p_partkey FROM part"),
    "debounce": (_debounce, """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM s GROUP BY user_id, n"""),
    "imports": (_imports, f"""WITH {_S}, n AS (SELECT path, ext, regexp_extract(path, 'mod([0-9]+)', 1)::BIGINT AS k FROM f) SELECT path, m.module, m.symbols, m.is_default, m.line_no::BIGINT AS line_no FROM (SELECT path, unnest(CASE ext
      WHEN '.py' THEN [{{'module': concat('mod', k + 35), 'symbols': 'a|b', 'is_default': false, 'line_no': 1}}, {{'module': concat('pkg.mod', k + 70), 'symbols': concat('pkg.mod', k + 70), 'is_default': true, 'line_no': 2}}, {{'module': concat('mod', k + 70), 'symbols': concat('mod', k + 70), 'is_default': true, 'line_no': 2}}]
      WHEN '.ts' THEN [{{'module': concat('./mod', k + 35), 'symbols': 'D|x|z', 'is_default': true, 'line_no': 1}}, {{'module': concat('side', k), 'symbols': '*', 'is_default': false, 'line_no': 2}}]
      WHEN '.java' THEN [{{'module': concat('com.x.Mod', k), 'symbols': concat('Mod', k), 'is_default': true, 'line_no': 1}}, {{'module': 'com.y', 'symbols': '*', 'is_default': false, 'line_no': 2}}]
      WHEN '.cs' THEN [{{'module': concat('B.C', k), 'symbols': 'A', 'is_default': true, 'line_no': 1}}, {{'module': 'X.Y', 'symbols': '*', 'is_default': false, 'line_no': 2}}, {{'module': 'System.Text', 'symbols': 'Text', 'is_default': true, 'line_no': 3}}]
      ELSE [{{'module': concat('a/b', k), 'symbols': concat('b', k), 'is_default': true, 'line_no': 1}}, {{'module': 'c/d', 'symbols': 'x', 'is_default': true, 'line_no': 2}}] END) AS m FROM n)"""),
    "links": (_links, f"""WITH {_S}, n AS (SELECT path, ext, regexp_extract(path, 'mod([0-9]+)', 1)::BIGINT AS k FROM f), x AS (
        SELECT path, k, ext, k + 35 AS t, CASE ext WHEN '.py' THEN 0.8::DOUBLE ELSE 0.95::DOUBLE END AS strength, CASE ext WHEN '.py' THEN 'a|b' ELSE 'D|x|z' END AS symbols FROM n WHERE ext IN ('.py', '.ts')
        UNION ALL SELECT path, k, ext, k + 70, 0.85::DOUBLE, concat('pkg.mod', k + 70, '|mod', k + 70) FROM n WHERE ext = '.py')
      SELECT x.path AS source, n.path AS target, x.strength, x.symbols FROM x JOIN n ON n.k = x.t"""),
    "line_budget": (_budget, """WITH r AS (SELECT conv_id AS report, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS total, text FROM conversations),
      c AS (SELECT *, CASE WHEN total <= 6 THEN total ELSE coalesce(max(CASE WHEN (starts_with(text, '##') OR text = '---') AND n <= 2 THEN n - 1 END) OVER (PARTITION BY report), 2) END AS cut FROM r)
      SELECT report, n AS ord, text FROM c WHERE n <= cut UNION ALL SELECT report, cut + 1 + i, CASE i WHEN 1 THEN concat(total - cut, ' lines omitted') WHEN 3 THEN 'end' ELSE '' END FROM c, range(4) t(i) WHERE n = 1 AND total > cut"""),
    "circular_edges": (lambda s, d: graph.mark_circular(users(s, d)).groupBy("type").agg(F.count("*").alias("links"), F.round(F.sum("strength"), 6).alias("strength")), f"""WITH RECURSIVE {_U}, l AS ({_LOW}), r AS (SELECT source, target FROM l UNION SELECT r.source, l.target FROM r JOIN l ON l.source = r.target),
      m AS (SELECT l.source, EXISTS (SELECT 1 FROM r WHERE r.source = l.target AND r.target = l.source) AS c FROM l) SELECT CASE WHEN c THEN 'circular' ELSE 'import' END AS type, count(*) AS links, round(sum(CASE WHEN c THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END), 6) AS strength FROM m GROUP BY 1"""),
    "calls": (lambda s, d: extract.calls(files(s, d)).groupBy("callee", "is_external").agg(F.count("*").alias("n")), f"""WITH {_S}, c AS (SELECT unnest(regexp_extract_all(content, '([A-Za-z_]\\w*(\\.[A-Za-z_]\\w*)*)\\s*\\(', 1)) AS name FROM f)
      SELECT regexp_extract(name, '[^.]*$') AS callee, contains(name, '.') AND NOT starts_with(name, 'self.') AND NOT starts_with(name, 'this.') AS is_external, count(*) AS n FROM c GROUP BY 1, 2"""),
}
_C = f"f AS (SELECT *, regexp_extract(path, 'f([0-9]+)\\.', 1) AS k, regexp_extract(path, '(\\.[^.]*)$', 1) AS ext FROM ({B.CODE_FILES}))"
_MARKED = f"""WITH RECURSIVE {_U}, l AS ({_LOW}), r AS (SELECT source, target FROM l UNION SELECT r.source, l.target FROM r JOIN l ON l.source = r.target),
      m AS (SELECT l.source, l.target, EXISTS (SELECT 1 FROM r WHERE r.source = l.target AND r.target = l.source) AS c FROM l)"""
_REL = "{'n': concat(%s), 'k': '%s', 's': %s, 'b': %s, 'o': %d}"
_one = lambda name, kind, sign, base, ord_: _REL % (name, kind, sign, base, ord_)
_DEFS |= {
    "data_models": (lambda s, d: symbols.data_models(code(s, d)), f"""WITH {_C} SELECT path AS file, m.f AS family, m.n AS name, m.s AS signature FROM (SELECT path, unnest(CASE ext
      WHEN '.py' THEN [{{'f': 'dataclass', 'n': concat('D', k), 's': 'x, y'}}, {{'f': 'validated', 'n': concat('M', k), 's': 'tag'}}] WHEN '.ts' THEN [{{'f': 'interface', 'n': concat('I', k), 's': 'id, tag'}}]
      WHEN '.java' THEN [{{'f': 'record', 'n': concat('R', k), 's': 'int a, int b'}}] ELSE [] END) AS m FROM f)"""),
    "symbols": (lambda s, d: symbols.symbols(code(s, d)).drop("exported"), f"""WITH {_C} SELECT path, m.n AS name, m.k AS kind, m.s AS signature, m.b AS inherits, m.o::BIGINT AS ord FROM (SELECT path, unnest(CASE ext
      WHEN '.py' THEN [{_one("'D', k", "class", "NULL", "NULL", 2)}, {_one("'M', k", "class", "NULL", "'BaseModel'", 5)}, {_one("'get_item'", "function", "'(a, b)'", "NULL", 7)}]
      WHEN '.ts' THEN [{_one("'I', k", "interface", "NULL", "NULL", 1)}, {_one("'handleReq'", "function", "'(a, b)'", "NULL", 5)}]
      WHEN '.java' THEN [{_one("'R', k", "record", "'(int a, int b)'", "NULL", 1)}, {_one("'C', k", "class", "NULL", "'Base'", 2)}, {_one("'getAll'", "method", "'(int n)'", "NULL", 3)}]
      ELSE [{_one("'Run', k", "function", "'(a int)'", "NULL", 1)}] END) AS m FROM f)"""),
    "function_naming": (lambda s, d: symbols.function_naming(code(s, d)), f"WITH {_C} SELECT CASE ext WHEN '.ts' THEN 'handle' ELSE 'get' END AS verb, sum(CASE ext WHEN '.java' THEN 2 ELSE 1 END)::BIGINT AS n, min_by(CASE ext WHEN '.ts' THEN 'handleReq' WHEN '.py' THEN 'get_item' ELSE 'getAll' END, path) AS example FROM f WHERE ext <> '.go' GROUP BY 1"),
    "frameworks": (lambda s, d: conventions.frameworks(code(s, d)), f"WITH {_C} SELECT DISTINCT 'FastAPI' AS name FROM f WHERE contains(path, '/api/')"),
    "layer_flows": (lambda s, d: conventions.layer_flows(code(s, d).withColumn("path", F.concat(F.lit("/w/service"), "path"))), f"WITH {_C} SELECT DISTINCT 'Data flow' AS name FROM f WHERE contains(path, 'model')"),
    "test_organisation": (lambda s, d: conventions.test_organisation(s.read.parquet(f"{d}/part.parquet").select(F.concat(F.when(F.col("p_size") % 3 == 0, "Test").otherwise("x"), "p_name").alias("stem"), F.col("p_brand").alias("dir"))), "SELECT p_brand AS dir, count(*) AS files FROM part WHERE p_size % 3 = 0 OR regexp_matches(lower(p_name), 'test|spec') GROUP BY 1"),
    "symbol_index": (_symbol_index, f"""WITH {_S}, n AS (SELECT path, rel, ext, regexp_extract(path, 'mod([0-9]+)', 1)::BIGINT AS k FROM f),
      x AS (SELECT k AS s, k + 35 AS t FROM n WHERE ext IN ('.py', '.ts') UNION ALL SELECT k, k + 70 FROM n WHERE ext = '.py'), e AS (SELECT x.s, x.t FROM x JOIN n ON n.k = x.t),
      i AS (SELECT t AS k, count(*) AS c FROM e GROUP BY 1), o AS (SELECT s AS k, count(*) AS c FROM e GROUP BY 1)
      SELECT path AS file, (2 * coalesce(i.c, 0) + coalesce(o.c, 0) + CASE WHEN ext IN ('.py', '.ts') THEN 25 ELSE 0 END - CASE WHEN rel LIKE 'tests/%' THEN 10 ELSE 0 END)::BIGINT AS score
      FROM n LEFT JOIN i USING (k) LEFT JOIN o USING (k) WHERE rel NOT LIKE 'node_modules/%' ORDER BY score DESC, file LIMIT 40"""),
    "circular_pairs": (_circular, f"{_MARKED} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM m WHERE c ORDER BY a, b LIMIT 5"),
    "cycle_count": (_cycle_count, f"{_MARKED} SELECT ceil(count(*) FILTER (c) / 2)::BIGINT AS cycles FROM m"),
    "dependency_chains": (_chains, f"""WITH {_U}, l AS ({_LOW}), s AS (SELECT target AS start FROM l GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8), {_walk_sql(4)}
      SELECT list_aggregate(chain::VARCHAR[], 'string_agg', '>') AS chain, len(chain) AS depth, start AS start_path, false AS starts_from_entry FROM w4 WHERE len(chain) >= 3 ORDER BY len(w4.chain) DESC, start LIMIT 5"""),
    "directory_clusters": (lambda s, d: chains.directory_clusters(files(s, d).select(F.col("path").alias("source"), F.col("path").alias("target"))), f"WITH {_S} SELECT dir AS name, count(*) AS files FROM f GROUP BY dir HAVING count(*) >= 3 ORDER BY files DESC, name LIMIT 3"),
    "ignore_rules": (_ignored, f"WITH {_S} SELECT path, rel LIKE 'lib/%' OR rel LIKE 'app/%' OR (ext = '.java' AND rel NOT LIKE 'src/%') AS ignored FROM f"),
    "module_clusters": (lambda s, d: chains.module_clusters(order(s, d)).withColumn("files", F.array_join("files", "|")), None),
    "report_architecture": (_report("architecture"), None),
    "report_map": (_report("map", code), None),
    "report_context": (_report("context"), None),
}

QUERIES = {k: q for k, (q, _) in _DEFS.items()} | catalog_workspace.QUERIES
ORACLES = {k: o for k, (_, o) in _DEFS.items() if o} | catalog_workspace.ORACLES
