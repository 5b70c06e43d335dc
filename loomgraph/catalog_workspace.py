"""Queries over the workspace of spellings and over change logs, and their SQL.

The SQL reads the text of the files by patterns and predicates of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import paths as P
from .operators import chains, extract, graph, resolve, rules, symbols, text
from .plans import workspace as W
from .plans.state import ensure_checkpoints
from .streaming import changes

_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_F = f"""p AS ({W.SPELLINGS}), f AS (SELECT path, content, substr(path, 4) AS rel, regexp_extract(path, '[^/]*$') AS basename, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext,
  regexp_replace(path, '/[^/]*$', '') AS dir, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM p)"""
_CLASS = f"""c AS (SELECT *, CASE WHEN list_has_any(string_split(lower(rel), '/')[1:-2], {_LIST(P.THIRD_PARTY)}) THEN 'third_party'
  WHEN list_has_any(string_split(lower(rel), '/'), {_LIST(P.TEST_DIRS)}) OR starts_with(lower(basename), 'test_') OR ends_with(lower(basename), '_test.py') OR contains(lower(basename), '.spec.') OR contains(lower(basename), '.test.') THEN 'test' ELSE 'app' END AS cls FROM f)"""
_STRUCT = f"""t AS (SELECT *, cls = 'app' AND NOT regexp_matches(lower(rel), '/(alembic|migrations|hooks)/') AND NOT list_contains({_LIST(P.UNSTRUCTURAL_FILES)}, lower(basename)) AND NOT regexp_matches(lower(basename), '\\.gen\\.(ts|js)x?$') AS structural FROM c)"""
_TOOL = f"(contains(lower(rel), 'config') OR regexp_matches(lower(stem), '{'|'.join(P.TOOLS)}') OR regexp_matches(lower(stem), '^next\\.|^vitest\\.') OR list_contains({_LIST(P.MANIFESTS)}, lower(stem)))"
_FILES = f"{_F}, {_CLASS}, {_STRUCT}"

#: message, DuckDB pattern
_INTEGRATION_SQL = (
    ("Database connection", "(?i)(create|get)Connection|createPool|pg[.]Pool|mysql[.]create|MongoClient|mongoose[.]connect|prisma[.][$]connect"), ("Database: SQLAlchemy", "SQLAlchemy|create_engine|sessionmaker|AsyncSession"),
    ("Database driver", "psycopg2|asyncpg|aiomysql|pymongo"), ("HTTP client: fetch", "fetch[[:space:]]*[(][\\x27\"]"), ("HTTP client: axios", "axios[.](get|post|put|delete|patch|request)"), ("HTTP client", "(?i)httpclient|http[.]request"),
    ("HTTP client: requests", "requests[.](get|post|put|delete|patch)"), ("HTTP client: async", "aiohttp[.]ClientSession|httpx[.]"), ("Message queue: RabbitMQ", "(?i)amqplib|amqp[.]|rabbitmq"), ("Message queue: Kafka", "(?i)kafkajs|kafka[.]|kafka(consumer|producer)"),
    ("Redis pub/sub", "(?i)redis[.](publish|subscribe|createclient)|ioredis"), ("Job queue: Bull", "(?i)bullmq|bull[.]|queue[(]"), ("Task queue: Celery", "[cC]elery"), ("Cloud SDK: AWS", "(?i)boto3|@aws-sdk"), ("Cloud SDK: Firebase", "(?i)firebase"),
    ("Cloud SDK: GCP", "(?i)@?google[.]cloud|@google-cloud"), ("Cloud SDK: Azure", "(?i)@azure/"), ("WebSocket client", "new[[:space:]]+WebSocket[[:space:]]*[(]"), ("WebSocket: Socket.IO", "(?i)socket[.]io|io[[:space:]]*[(]"),
    ("GraphQL client", "(?i)apolloclient|gql`|graphql[(]"), ("gRPC", "grpc[.]|@grpc/|grpcio"))
_STATE_SQL = (
    ("Singleton pattern", "getInstance[[:space:]]*[(][[:space:]]*[)]", ""), ("Singleton decorator", "@[sS]ingleton", ""), ("Service locator pattern", "(?i)servicelocator|container[.](resolve|get)|injector[.]get", ""),
    ("React Context (shared state)", "createContext[[:space:]]*[(]", ""), ("Redux store", "createStore|configureStore|createSlice", ""), ("Zustand store", "zustand|create[[:space:]]*[(][[:space:]]*[(]set[)]", ""),
    ("Global mutable state", "(?m)^(let|var)[[:space:]]+[[:word:]]+[[:space:]]*[=:][[:space:]]*(new[[:space:]]+(Map|Set|Array)|[{]|\\[)", ".ts,.tsx,.js,.jsx"), ("Module-level mutable state", "(?m)^[A-Z_][A-Z0-9_]*[[:space:]]*[=:][[:space:]]*([{]|\\[|set[(]|dict[(])", ".py"))


def _rules_sql(family: str, rules_) -> str:
    rows = ", ".join(f"('{m}', '{p}', '{e}')" for m, p, e in rules_)
    return f"WITH {_F}, r(message, pattern, exts) AS (VALUES {rows}) SELECT path AS file, '{family}' AS family, message FROM f JOIN r ON regexp_matches(content, pattern) AND (exts = '' OR list_contains(string_split(exts, ','), ext))"


def _imports(s, d):
    out = extract.imports(W.spellings(s, d).filter(F.col("ext").isin(".ts", ".tsx", ".js", ".jsx", ".mjs")))
    return out.select("path", "module", F.array_join("symbols", "|").alias("symbols"), "is_default", F.col("line_no").cast("long").alias("line_no"))


_Q = "[\\x27\"]([^\\x27\"]+)[\\x27\"]"
_CLEAN = "list_filter(list_transform(string_split({x}, ','), lambda y: trim(regexp_replace(regexp_replace(trim(y), '^type\\s+', ''), '\\s+as\\s+.*', ''))), lambda y: y <> '' AND y <> 'type')"


def _imports_sql() -> str:
    """The forms in their order, each a row of (pattern, module's group, names' group, default's group, default or not)."""
    forms = (
        (f"^import\\s+{_Q}\\s*;?$", 1, 0, 0, "false"), (f"^export\\s*[{{]([^}}]+)[}}]\\s*from\\s*{_Q}", 2, 1, 0, "false"), (f"^export\\s*[*]\\s*(as\\s+\\w+\\s*)?from\\s*{_Q}", 2, 0, 0, "false"),
        (f"^import\\s+(type\\s+)?(\\w+)\\s*,\\s*[{{]([^}}]+)[}}]\\s*from\\s*{_Q}", 4, 3, 2, "true"), (f"^import\\s+(type\\s+)?(\\w+)\\s*,\\s*[*]\\s*as\\s+(\\w+)\\s*from\\s*{_Q}", 4, 3, 2, "true"),
        (f"^import\\s+(type\\s+)?[*]\\s*as\\s+(\\w+)\\s*from\\s*{_Q}", 3, 2, 0, "true"), (f"^import\\s+(type\\s+)?[{{]([^}}]+)[}}]\\s*from\\s*{_Q}", 3, 2, 0, "false"), (f"^import\\s+(type\\s+)?(\\w+)\\s+from\\s*{_Q}", 3, 2, 0, "true"),
        (f"(const|let|var)\\s+[{{]([^}}]+)[}}]\\s*=\\s*require\\s*[(]\\s*{_Q}\\s*[)]", 3, 2, 0, "false"), (f"(const|let|var)\\s+(\\w+)\\s*=\\s*require\\s*[(]\\s*{_Q}\\s*[)]", 3, 2, 0, "true"), (f"import\\s*[(]\\s*{_Q}\\s*[)]", 1, 0, 0, "false"))
    get = lambda p, g: f"regexp_extract(t, '{p}', {g})"
    cases = []
    for p, module, names, first, default in forms:
        listed = "['*']" if not names else _CLEAN.format(x=get(p, names))
        if first:
            listed = f"list_concat([{get(p, first)}], {listed})"
        cases.append(f"WHEN regexp_matches(t, '{p}') THEN {{'module': {get(p, module)}, 'symbols': array_to_string({listed}, '|'), 'is_default': {default}}}")
    return f"""WITH {_F}, l AS (SELECT path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1)::BIGINT AS line_no FROM f WHERE ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs')),
      m AS (SELECT path, line_no, CASE {' '.join(cases)} END AS m FROM (SELECT path, line_no, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM l))
      SELECT path, m.module AS module, m.symbols AS symbols, m.is_default AS is_default, line_no FROM m WHERE m IS NOT NULL"""


def _entries(s, d):
    return rules.entry_points(W.spellings(s, d)).withColumn("route_count", F.col("route_count").cast("long"))


def _entries_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(content, '{p}'))"
    has = lambda *x: "(" + " OR ".join(f"contains(content, '{t}')" for t in x) + ")"
    e = lambda reason, confidence, category, routes="NULL": f"{{'reason': '{reason}', 'confidence': {confidence}, 'category': '{category}', 'route_count': ({routes})::BIGINT}}"
    high, medium = "'high'", "'medium'"
    by = lambda c: f"CASE WHEN {c} > 0 THEN 'high' ELSE 'medium' END"
    fast, flask = n("(?i)@(app|router)[.](get|post|put|delete|patch|options|head)\\s*[(]"), n("(?i)@(app|blueprint|bp)[.](route|get|post|put|delete|patch)\\s*[(]")
    routes, nest, calls = n("[.](get|post|put|delete|patch|use)\\s*[(]\\s*[\\x27\"]"), n("@(Get|Post|Put|Delete|Patch|All)\\s*[(]"), n("[.](get|post|put|delete|patch)\\s*[(]")
    mapped, attributes = n("[.]Map(Get|Post|Put|Delete|Patch)\\s*[(]"), n("\\[(Http(Get|Post|Put|Delete|Patch)|Route)\\]")
    spring, jax = n("@(Get|Post|Put|Delete|Patch|Request)Mapping"), n("@(GET|POST|PUT|DELETE|PATCH)")
    body = "greatest(1, len(list_filter(string_split(content, chr(10)), lambda y: regexp_matches(y, '\\S'))))"
    guard = f"{has('if __name__')} AND {has('__main__')}"
    py, js, cs, java = "ext = '.py'", "ext IN ('.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs')", "ext = '.cs'", "ext = '.java'"
    cascade = [
        (f"s IN ('index', 'mod', '__init__') AND ({n('(?m)^export\\s+')} + {n('from\\s+[\\x27\"]')}) / {body} > 0.4", e("Re-exports", medium, "barrel")),
        (f"s IN ('index', 'mod', '__init__') AND {py} AND {n('(?m)^from\\s+[.]')} > 2 AND {n('(?m)^from\\s+[.]')} / {body} > 0.3", e("Re-exports", medium, "barrel")),
        (f"{_TOOL} AND {has('module.exports', 'export default', 'defineConfig', 'createConfig')}", e("Configuration", high, "tooling")), (_TOOL, "NULL"),
        (f"{py} AND {has('FastAPI(', 'from fastapi')} AND {fast} > 0", e("FastAPI", high, "runtime", fast)), (f"{py} AND {has('Flask(__name__)', 'from flask import Flask')} AND {flask} > 0", e("Flask", high, "runtime", flask)),
        (f"{py} AND s = 'urls' AND {has('urlpatterns')}", e("Django urls", high, "runtime", n("path\\s*[(]|re_path\\s*[(]|url\\s*[(]"))), (f"{py} AND s = 'views' AND {has('def get(', 'def post(', '@api_view')}", e("Django views", medium, "runtime", "1")),
        (f"{py} AND s IN ('wsgi', 'asgi') AND {has('application')}", e("Server gateway", high, "runtime", "1")), (f"{py} AND s = '__main__'", e("Package main", high, "runtime", "1")),
        (f"{py} AND ({has('@click.command', '@click.group')} OR {has('@app.command')} AND {has('import typer')})", e("Command line", high, "tooling")),
        (f"{py} AND {guard} AND {has('uvicorn.run', 'app.run(', '.serve(')}", e("Main guard with a server", high, "runtime", "1")), (f"{py} AND {guard}", e("Main guard", medium, "tooling")),
        (f"{py} AND s IN ('main', 'app', 'server', 'application')", e("Name", medium, "runtime", "0")),
        (f"{js} AND regexp_matches(lower(rel), '(pages|app)/api/') AND {has('export default', 'export async function')}", e("Next.js route", high, "runtime", "1")),
        (f"{js} AND s = 'middleware' AND ext IN ('.ts', '.js') AND {has('NextRequest', 'NextResponse')}", e("Next.js middleware", high, "runtime", "1")),
        (f"{js} AND ({has('express()', 'fastify(', 'new Koa(')} OR {routes} > 2)", e("Web routes", by(routes), "runtime", routes)), (f"{js} AND {has('@Controller', '@Injectable')} AND {nest} > 0", e("NestJS", high, "runtime", nest)),
        (f"{js} AND {has('new Hono(', 'Hono.get', 'app.get(')} AND {calls} > 0", e("Hono", high, "runtime", calls)), (f"{js} AND {has('require.main === module')}", e("Main module", medium, "tooling")),
        (f"{js} AND regexp_matches(lower(rel), '/(bin|cli)/') AND {has('#!/', 'commander', 'yargs')}", e("Command line", medium, "tooling")), (f"{js} AND s IN ('server', 'main', 'app', 'index') AND {has('.listen(', 'createServer')}", e("Server", high, "runtime", "1")),
        (f"{js} AND s IN ('main', 'server')", e("Name", medium, "runtime", "0")),
        (f"{cs} AND s = 'program' AND {has('WebApplication.CreateBuilder', 'CreateHostBuilder', 'UseStartup', 'app.Run()')}", e("Web host", high, "runtime", f"greatest(1, {mapped})")),
        (f"{cs} AND s = 'program' AND {has('static void Main', 'static async Task Main')}", e("Console main", medium, "tooling")), (f"{cs} AND {has('[ApiController]', '[Controller]')}", e("Controller", by(attributes), "runtime", attributes)),
        (f"{cs} AND s = 'startup' AND {has('ConfigureServices')}", e("Startup", high, "runtime", "1")), (f"{java} AND {has('@SpringBootApplication')}", e("Spring Boot", high, "runtime", "1")),
        (f"{java} AND {has('@RestController', '@Controller')}", e("Controller", by(spring), "runtime", spring)), (f"{java} AND {has('@Path(')} AND {has('@GET', '@POST')}", e("JAX-RS", high, "runtime", jax)),
        (f"{java} AND {has('public static void main(String')}", e("Static main", medium, "tooling"))]
    whens = " ".join(f"WHEN {on} THEN {value}" for on, value in cascade)
    return f"WITH {_F}, x AS (SELECT path, CASE {whens} END AS e FROM (SELECT *, lower(stem) AS s FROM f)) SELECT path, e.reason AS reason, e.confidence AS confidence, e.category AS category, e.route_count AS route_count FROM x WHERE e IS NOT NULL"


def _predicates(s, d):
    rel = F.col("rel")
    settings = ["**/migrations", "docs/**", "*.x", "**/*.gen.ts", "ab"]
    return W.spellings(s, d).select("path", "file_class", P.is_structural(rel).alias("structural"), P.is_tooling(rel).alias("tooling"), P.is_tracked(F.col("path")).alias("tracked"), P.purpose(F.col("dir")).alias("purpose"), P.is_settings_excluded(F.col("path"), settings).alias("excluded"), P.line_end(F.col("content")).alias("line_end"))


_PREDICATES_SQL = f"""WITH {_FILES}, u(name, purpose) AS (VALUES {', '.join(f"('{k}', '{v}')" for k, v in P.PURPOSES.items())})
  SELECT path, cls AS file_class, structural, {_TOOL} AS tooling, list_contains({_LIST(P.TRACKED)}, ext) AND NOT list_has_any(string_split(lower(path), '/')[2:-2], {_LIST((*P.UNTRACKED_DIRS, '_kb'))}) AS tracked,
    coalesce(u.purpose, 'General') AS purpose, contains(lower(path), 'migrations') OR contains(lower(path), 'docs') OR contains(lower(path), '.gen.ts') AS excluded, CASE WHEN contains(content, chr(13) || chr(10)) THEN 'CRLF' ELSE 'LF' END AS line_end
  FROM t LEFT JOIN u ON u.name = lower(regexp_extract(dir, '[^/]*$'))"""
_E = f"e AS ({W.EDGES}), {_FILES}"
_APP_IN = "i AS (SELECT target AS file, count(DISTINCT source) AS importers FROM e JOIN t ON t.path = e.source AND cls = 'app' WHERE source <> target GROUP BY 1)"
_DEG = "g AS (SELECT file, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT source AS file, 0 AS i, 1 AS o FROM {0} UNION ALL SELECT target, 1, 0 FROM {0}) GROUP BY file)"


def _impact(s, d):
    out = graph.impact_summary(W.edges(s, d), W.spellings(s, d), _TARGET(s, d))
    return out.select("file", "dependents_count", F.array_join(F.transform("top_dependents", lambda x: F.concat_ws(":", x["file"], x["dependent_count"].cast("string"))), "|").alias("top_dependents"), "hub_risk")


def _TARGET(s, d):
    """The file of part 3."""
    return W.spellings(s, d).filter(F.col("path").startswith("/w/d3/")).first()["path"]


def _edits(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "user_id", "ts", (F.col("event_id") % 3).alias("changes"), (F.col("event_id") % 260).alias("chars"), (F.col("event_id") % 11).alias("lines"), (F.col("event_id") % 500).alias("replaced"),
                    F.when(F.col("event_type") == "purchase", "save").otherwise("edit").alias("kind"))


def _bulk(s, d):
    on = changes.is_bulk_edit(*map(F.col, ("changes", "chars", "lines", "replaced")))
    return _edits(s, d).filter(on).select("event_id")


def _triggers(mode):
    def query(s, d):
        out = changes.triggers(_edits(s, d), mode, "user_id")
        return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")
    return query


_BULK = "event_id % 3 >= 1 AND (event_id % 3 >= 2 OR event_id % 260 >= 200 OR event_id % 11 >= 8 OR event_id % 500 >= 400)"


def _sessions(where: str, gap: str) -> str:
    return f"""WITH o AS (SELECT * FROM events WHERE {where}), g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL {gap} THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM s GROUP BY user_id, n"""


def _stale(s, d):
    e = _edits(s, d)
    return changes.stale_transitions(e, "user_id", "ts", F.col("kind") == "edit", "event_id").select("event_id", "user_id")


def _callers(s, d):
    links = W.edges(s, d).withColumn("symbols", F.array().cast("array<string>"))
    named = W.spellings(s, d).select("path", F.col("basename").alias("name"))
    return symbols.callers(named, links, W.spellings(s, d)).withColumn("used_in", F.array_join("used_in", "|"))


def _call_links(s, d):
    f = W.spellings(s, d).filter("ext = '.py'").withColumn("content", F.concat("content", F.lit("\nmain.get(1)\n"), F.lit("x.web.route(2)\nweb.route(3)\nweb.nothing(1)")))
    out = resolve.call_links(extract.calls(f), f.filter("dir in ('/w/d16', '/w/d17')").unionByName(f.filter("dir = '/w/d18'")), True)
    return out.select("source", "target", "strength", F.array_join("symbols", "|").alias("symbols"))


def _sections(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    t = F.col("text")
    kept = F.concat(t, F.lit("\n<s>\nold\n<e>\nrest"))
    return docs.select("doc_id", F.md5(text.merge_section(t, F.lit("new"), "<s>", "<e>")).alias("added"), F.md5(text.merge_section(kept, F.lit("new"), "<s>", "<e>")).alias("replaced"), F.md5(text.remove_section(kept, "<s>", "<e>")).alias("removed"))


def _groups(s, d):
    f = W.spellings(s, d)
    return rules.integrations(f).withColumn("group", F.explode(rules.integration_group(F.col("message")))).groupBy("group").agg(F.count("*").alias("findings"), F.countDistinct("file").alias("files"))


def _stats(s, d):
    ensure_checkpoints(s)
    e = W.edges(s, d)
    return graph.graph_stats(e, W.spellings(s, d), merged=True).join(graph.graph_stats(e).select(F.col("cycle_groups").alias("groups_before")))


def _circular(s, d):
    ensure_checkpoints(s)
    return chains.circular_pairs(graph.mark_circular(W.edges(s, d)), 5, W.spellings(s, d))


_REACH = "l AS (SELECT DISTINCT source, target FROM e WHERE source <> target), r AS (SELECT source, target FROM l UNION SELECT r.source, l.target FROM r JOIN l ON l.source = r.target)"
_DEFS = {
    "integration_rules": (lambda s, d: rules.integrations(W.spellings(s, d)), _rules_sql("integration", [(m, p, "") for m, p in _INTEGRATION_SQL])),
    "global_state_rules": (lambda s, d: rules.global_state(W.spellings(s, d)), _rules_sql("global_state", _STATE_SQL)),
    "integration_groups": (_groups, f"""WITH x AS ({_rules_sql("integration", [(m, p, "") for m, p in _INTEGRATION_SQL])}), g AS (SELECT file, message, unnest(CASE WHEN NOT regexp_matches(message, 'Database|DB|SQL|HTTP|API|fetch|Queue|Kafka|Redis') THEN ['other']
      ELSE list_filter([CASE WHEN regexp_matches(message, 'Database|DB|SQL') THEN 'database' END, CASE WHEN regexp_matches(message, 'HTTP|API|fetch') THEN 'http' END, CASE WHEN regexp_matches(message, 'Queue|Kafka|Redis') THEN 'queue' END], lambda y: y IS NOT NULL) END) AS "group" FROM x)
      SELECT "group", count(*) AS findings, count(DISTINCT file) AS files FROM g GROUP BY 1"""),
    "script_imports": (_imports, _imports_sql()),
    "entry_points": (_entries, _entries_sql()),
    "path_predicates": (_predicates, _PREDICATES_SQL),
    "file_naming": (lambda s, d: rules.file_naming(W.spellings(s, d)), f"""WITH {_F}, n AS (SELECT path, CASE WHEN stem = 'index' OR contains(stem, 'test') OR contains(stem, 'spec') THEN NULL WHEN contains(stem, '-') THEN 'kebab' WHEN contains(stem, '_') THEN 'snake' WHEN regexp_matches(stem, '^[A-Z]') THEN 'Pascal' WHEN regexp_matches(stem, '[a-z][A-Z]') THEN 'camel' END AS style FROM f),
      c AS (SELECT style, count(*) AS n, min(path) AS example FROM n WHERE style IS NOT NULL GROUP BY style) SELECT style, n, example, row_number() OVER (ORDER BY n DESC, style) = 1 AND n > 0.3 * (SELECT count(*) FROM f) AS dominant FROM c"""),
    "function_verbs": (lambda s, d: symbols.function_naming(W.spellings(s, d)).drop("example"), f"""WITH {_F}, n AS (SELECT unnest(list_concat(list_concat(regexp_extract_all(content, 'def\\s+(\\w+)\\s*[(]', 1), list_concat(regexp_extract_all(content, 'function\\s+(\\w+)\\s*[(]', 1), regexp_extract_all(content, 'const\\s+(\\w+)\\s*=\\s*(async\\s+)?[(]', 1))),
      list_concat(regexp_extract_all(content, '(public|protected|private)\\s+(static\\s+)?\\w+\\s+(\\w+)\\s*[(]', 3), regexp_extract_all(content, '(public|protected|private|internal)\\s+(static\\s+)?(async\\s+)?\\w+\\s+(\\w+)\\s*[(]', 4)))) AS name FROM f)
      SELECT regexp_extract(name, '^({'|'.join(symbols.VERBS)})[_A-Z]', 1) AS verb, count(*) AS n FROM n WHERE regexp_matches(name, '^({'|'.join(symbols.VERBS)})[_A-Z]') GROUP BY 1"""),
    "file_hubs": (lambda s, d: graph.hubs(W.edges(s, d), 12, W.spellings(s, d)).join(graph.hub_risk(W.edges(s, d), W.spellings(s, d)), "file", "left"), f"""WITH {_E}, {_APP_IN}, {_DEG.format('e')}, h AS (SELECT g.*, 2 * (in_degree + out_degree) AS score FROM g JOIN t ON t.path = g.file AND structural WHERE in_degree + out_degree > 2), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, file) AS rank FROM h QUALIFY rank <= 12)
      SELECT k.*, importers, CASE WHEN importers > 8 THEN 'High' WHEN importers > 4 THEN 'Medium' WHEN importers IS NOT NULL THEN 'Low' END AS risk FROM k LEFT JOIN i USING (file)"""),
    "file_centrality": (lambda s, d: graph.centrality(W.edges(s, d), 8, W.spellings(s, d)), f"""WITH {_E}, x AS (SELECT e.source, e.target FROM e JOIN t a ON a.path = e.source AND a.cls = 'app' JOIN t b ON b.path = e.target AND b.cls = 'app' WHERE e.source <> e.target), {_DEG.format('x')}
      SELECT file, 2 * in_degree + out_degree AS score, in_degree, out_degree FROM g JOIN t ON t.path = g.file AND structural ORDER BY score DESC, file LIMIT 8"""),
    "impact_summary": (_impact, f"""WITH {_E}, y AS (SELECT path, cls FROM t WHERE starts_with(path, '/w/d3/')), {_DEG.format('e')}, x AS (SELECT DISTINCT e.source AS file FROM e JOIN y ON y.path = e.target JOIN t ON t.path = e.source WHERE e.source <> e.target AND t.cls <> 'third_party'),
      z AS (SELECT file, in_degree FROM x JOIN g USING (file) ORDER BY in_degree DESC, file LIMIT 5), k AS (SELECT count(*) AS n FROM x)
      SELECT y.path AS file, k.n AS dependents_count, (SELECT string_agg(concat(file, ':', in_degree), '|' ORDER BY in_degree DESC, file) FROM z) AS top_dependents, CASE WHEN k.n >= 5 AND y.cls <> 'test' THEN 'HIGH' WHEN k.n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS hub_risk FROM y, k"""),
    "file_cycles": (_circular, f"""WITH RECURSIVE {_E}, {_REACH} SELECT DISTINCT least(l.source, l.target) AS a, greatest(l.source, l.target) AS b FROM l JOIN r ON r.source = l.target AND r.target = l.source
      JOIN t x ON x.path = l.source AND x.structural JOIN t y ON y.path = l.target AND y.structural ORDER BY a, b LIMIT 5"""),
    "file_graph_stats": (_stats, f"""WITH RECURSIVE {_E}, {_REACH}, m AS (SELECT a.source, a.target FROM l a LEFT JOIN l b ON a.source = b.target AND a.target = b.source WHERE b.source IS NULL OR a.source < a.target),
      q AS (SELECT source, target FROM m UNION SELECT q.source, m.target FROM q JOIN m ON m.source = q.target),
      before AS (SELECT DISTINCT a.source AS n, least(a.source, min(a.target) OVER (PARTITION BY a.source)) AS c FROM r a JOIN r b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target),
      after AS (SELECT DISTINCT a.source AS n, least(a.source, min(a.target) OVER (PARTITION BY a.source)) AS c FROM q a JOIN q b ON a.source = b.target AND a.target = b.source WHERE a.source <> a.target)
      SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM l) AS links, (SELECT count(*) FROM l a JOIN l b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target) AS two_way,
        (SELECT count(DISTINCT c) FROM after) AS cycle_groups, (SELECT count(DISTINCT c) FROM before) AS groups_before"""),
    "callers": (_callers, f"""WITH {_E}, h AS (SELECT DISTINCT t2.path, t2.basename AS name, t.rel FROM e JOIN t ON t.path = e.source AND t.cls = 'app' JOIN t t2 ON t2.path = e.target WHERE e.source <> e.target), n AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY rel) AS i, count(*) OVER (PARTITION BY path, name) AS c FROM h)
      SELECT path, name, concat(string_agg(CASE WHEN len(string_split(rel, '/')) > 2 THEN regexp_extract(rel, '[^/]*/[^/]*$') ELSE rel END, '|' ORDER BY i), CASE WHEN any_value(c) > 5 THEN concat('|(+', any_value(c) - 5, ' more)') ELSE '' END) AS used_in FROM n WHERE i <= 5 GROUP BY path, name"""),
    "call_links": (_call_links, f"""WITH {_F}, y AS (SELECT path, dir, stem FROM f WHERE ext = '.py'), z AS (SELECT * FROM y WHERE dir IN ('/w/d16', '/w/d17', '/w/d18'))
      SELECT y.path AS source, z.path AS target, CASE z.stem WHEN 'main' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS strength, CASE z.stem WHEN 'main' THEN 'get' ELSE 'nothing|route' END AS symbols FROM y JOIN z ON z.stem IN ('main', 'web') AND y.path <> z.path"""),
    "bulk_edits": (_bulk, f"SELECT event_id FROM events WHERE {_BULK}"),
    "triggers_on_save": (_triggers("onSave"), _sessions(f"event_type = 'purchase' OR {_BULK}", "2 SECOND")),
    "triggers_idle": (_triggers("idle"), _sessions("true", "30 SECOND")),
    "stale_transitions": (_stale, "WITH s AS (SELECT event_id, user_id, event_type <> 'purchase' AS stale, lag(event_type <> 'purchase', 1, false) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id FROM s WHERE stale AND NOT before"),
    "marked_sections": (_sections, """SELECT doc_id, md5(concat(text, CASE WHEN regexp_matches(text, '\\S') THEN chr(10) || chr(10) ELSE '' END, '<s>', chr(10), 'new', chr(10), '<e>', chr(10))) AS added,
      md5(concat(text, chr(10), '<s>', chr(10), 'new', chr(10), '<e>', chr(10), 'rest')) AS replaced, md5(concat(text, 'rest')) AS removed FROM documents"""),
}

QUERIES = {k: q for k, (q, _) in _DEFS.items()}
ORACLES = {k: o for k, (_, o) in _DEFS.items() if o}
