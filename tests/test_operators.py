"""Small workspaces with expected links, and properties."""

from pyspark.sql import functions as F

from loomgraph.functions import paths as P
from loomgraph.operators import extract, graph, resolve, rules, text
from loomgraph.plans.state import ensure_checkpoints
from loomgraph.sources.scan import assistants, scan, with_parts


def workspace(spark, files: dict):
    return with_parts(spark.createDataFrame(list(files.items()), "path string, content string"), "/w")


def found(spark, files: dict):
    f = workspace(spark, files)
    out = resolve.links(resolve.resolve_imports(extract.imports(f), f))
    return {(r.source, r.target): (r.strength, r.symbols, r.lines) for r in out.collect()}


def test_python_package(spark):
    got = found(spark, {"/w/app/main.py": "from app.models import User\nimport app.util as u", "/w/app/models.py": "from .util import helper", "/w/app/util.py": "from app.models import User"})
    assert got == {
        ("/w/app/main.py", "/w/app/models.py"): (0.75, ["User"], [1]), ("/w/app/main.py", "/w/app/util.py"): (0.85, ["app.util", "util"], [2]),
        ("/w/app/models.py", "/w/app/util.py"): (0.75, ["helper"], [1]), ("/w/app/util.py", "/w/app/models.py"): (0.75, ["User"], [1])}


def test_typescript(spark):
    got = found(spark, {
        "/w/src/index.ts": "export * from './a';", "/w/src/a.ts": "import B, { c as d, type E } from './b'\nimport R from 'react'", "/w/src/b.ts": "import {\n  x\n} from './a'",
        "/w/src/c.cjs": "const a = require('./a')", "/w/src/react.ts": "export const x = 1"})
    assert got == {("/w/src/index.ts", "/w/src/a.ts"): (0.75, ["*"], [1]), ("/w/src/a.ts", "/w/src/b.ts"): (0.95, ["B", "c", "E"], [1]), ("/w/src/a.ts", "/w/src/react.ts"): (0.85, ["R"], [2])}


def test_resolution_ties(spark):
    code = "export const k = 1"
    base = {"/w/x/foo.js": code, "/w/x/foo.ts": code, "/w/y/foo.ts": code}
    for source, module, target in (("/w/z/s.ts", "foo", "/w/x/foo.ts"), ("/w/x/s.tsx", "./foo", "/w/x/foo.ts"), ("/w/x/s.tsx", "@scope/x/foo", "/w/x/foo.js"), ("/w/x/s.ts", "./foo.js", None)):
        got = found(spark, base | {source: f"import a from '{module}'"})
        assert list(got) == ([(source, target)] if target else []), module


def test_java(spark):
    got = found(spark, {"/w/com/a/Main.java": "import com.b.Util;\nimport com.b.*;", "/w/com/b/Util.java": "class Util {}"})
    assert got == {("/w/com/a/Main.java", "/w/com/b/Util.java"): (0.85, ["Util"], [1])}


def test_classification(spark):
    want = {"src/a.py": "app", "tests/test_a.py": "test", "node_modules/x/index.js": "third_party", "pkg/build/a.ts": "third_party", "src/a.spec.ts": "test", "db/migrations/1.py": "app"}
    df = spark.createDataFrame([(k,) for k in want], "rel string")
    assert {r.rel: r.c for r in df.select("rel", P.file_class(F.col("rel")).alias("c")).collect()} == want


def test_components_of_two_cycles(spark):
    ensure_checkpoints(spark)
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "a"), ("d", "b"), ("x", "a")], "source string, target string").withColumn("type", F.lit("import")).withColumn("strength", F.lit(0.75))
    assert {(r.node, r.component, r["size"]) for r in graph.strong_components(e).collect()} == {(n, "a", 4) for n in "abcd"}
    marked = {(r.source, r.target): r.type for r in graph.mark_circular(e).collect()}
    assert marked.pop(("x", "a")) == "import" and set(marked.values()) == {"circular"}


def test_degrees_sum_to_links(spark):
    e = spark.createDataFrame([(i % 7, i % 5) for i in range(50)], "source long, target long")
    r = graph.degrees(e).agg(F.sum("in_degree"), F.sum("out_degree")).first()
    assert tuple(r) == (50, 50)


def test_line_budget(spark):
    rows = [("r", i, f"line {i}") for i in range(250)]
    out = text.line_budget(spark.createDataFrame(rows, "report string, ord long, text string"), 200).orderBy("ord").collect()
    assert len(out) == 200 and out[-1].text == "end" and out[-3].text == "54 lines omitted"


def test_fingerprint_order(spark):
    rows = [("a", 1, 2), ("b", 3, 4), ("c", 5, 6)]
    one = lambda r: text.fingerprint(spark.createDataFrame(r, "path string, mtime long, size long")).first().fingerprint
    assert one(rows) == one(rows[::-1]) != one([("a", 1, 3), *rows[1:]])


def test_naming_and_entry_points(spark):
    f = workspace(spark, {"/w/a-b.ts": "x", "/w/a_b.py": "x", "/w/Ab.ts": "x", "/w/aB.ts": "x", "/w/ab.ts": "x", "/w/index.ts": "export * from './a'", "/w/main.py": "if __name__ == '__main__':\n    uvicorn.run(app)"})
    assert {r["style"]: (r["n"], r["dominant"]) for r in rules.file_naming(f).collect()} == {k: (1, False) for k in ("kebab", "snake", "Pascal", "camel")}
    got = {r.path: (r.reason, r.category) for r in rules.entry_points(f).collect()}
    assert got == {"/w/index.ts": ("Re-exports", "barrel"), "/w/main.py": ("Main guard with a server", "runtime")}


def test_scan(spark, tmp_path):
    for name, body in (("a.py", "import b"), ("node_modules/x.js", "1"), ("empty.ts", ""), ("note.txt", "n")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(body)
    got = scan(spark, str(tmp_path)).collect()
    assert [(r.rel, r.content, r.ext) for r in got] == [("a.py", "import b", ".py")]


def test_scan_profiles(spark, tmp_path):
    for name in ("a.py", "b.py", "c.ts", "out/d.py", "e2e/e.ts", "vendor/f.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda **k: {r.rel for r in scan(spark, str(tmp_path), **k).collect()}
    assert names() == {"a.py", "b.py", "c.ts", "out/d.py", "e2e/e.ts"}
    assert names(profile="broad") == {"a.py", "b.py", "c.ts"}
    assert names(profile="broad", never=["out"], content=False) == {"a.py", "b.py", "c.ts", "out/d.py"}
    assert names(most=1) == {"a.py", "c.ts"}
    assert names(most=2, by_extension=False) == {"a.py", "b.py"}


def test_assistants(spark):
    listing = spark.createDataFrame([(".cursor/rules",), ("AGENTS.md",), ("docs/CLAUDE.md",), (".cursorrules",), (None,)], "rel string")
    assert {r.id for r in assistants(listing).collect()} == {"cursor", "other"}
    assert assistants(listing.limit(0)).count() == 0
