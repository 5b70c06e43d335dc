"""Symbols, models, clusters, reports, exclusions, state and the streaming run on small inputs."""

import pytest
from pyspark.sql import functions as F

from loomgraph import catalog
from loomgraph.operators import chains, conventions, graph, report, symbols, text
from loomgraph.sources import ignore
from loomgraph.sources.scan import with_parts
from loomgraph.streaming import changes


def workspace(spark, files: dict):
    return with_parts(spark.createDataFrame(list(files.items()), "path string, content string"), "/w")


def test_python_symbols_and_fallback(spark):
    f = workspace(spark, {
        "/w/a.py": "class A(B.C):\n    def __init__(self, x, *, y): pass\n    def _hidden(self): pass\n    def go(self, a, b, c, d, e): pass\nasync def run(): pass",
        "/w/broken.py": "def ok(a, b, c, d)\n  print 1", "/w/none.py": None, "/w/empty.py": ""})
    got = {(r.path[3:], r.name, r.kind, r.signature, r.inherits, r.ord) for r in symbols.symbols(f).collect()}
    assert got == {
        ("a.py", "A", "class", None, "B.C", 1), ("a.py", "__init__", "method", "(x, y)", None, 2), ("a.py", "go", "method", "(a, b, c, d, ...)", None, 4),
        ("a.py", "run", "function", "()", None, 5), ("broken.py", "ok", "function", "(a, b, c, ...)", None, 1)}


def test_script_symbols(spark):
    f = workspace(spark, {"/w/a.ts": "export const f = (a, b) => a\nexport const g =\n  (x) => x\nexport const n = 1\nfunction hidden() {}\nexport class K<T> extends Base {}\nexport type T = {}"})
    got = {(r.name, r.kind, r.signature, r.inherits) for r in symbols.symbols(f).collect()}
    assert got == {("f", "const", "(a, b)", None), ("g", "const", "(x)", None), ("n", "const", None, None), ("K", "class", None, "Base"), ("T", "type", None, None)}


def test_script_parameters(spark):
    f = workspace(spark, {"/w/a.ts": "export function f({ a, b: { c } }: P, [d]: Q = [], e?: number, ...rest: R[]) {}\nexport async function g(\n  a: Map<string, number>, // first\n  cb: (x: number, y: number) => void,\n) {}\n"
                                     "export const h = async ({ a }, b = 1) => a\nexport const one = x => x\nexport const typed: (a: A) => B = (a) => a\nexport const n = list.map((x) => x)\nexport let m = 1\n"
                                     "export function many(this: W, a, b, c, d, e) {}"})
    got = {(r.name, r.kind, r.signature, r.ord) for r in symbols.symbols(f).collect()}
    assert got == {
        ("f", "function", "(..., ..., e, ...rest)", 1), ("g", "function", "(a, cb)", 2), ("h", "const", "(..., b)", 6), ("one", "const", "(x)", 7),
        ("typed", "const", "(a)", 8), ("n", "const", None, 9), ("m", "const", None, 10), ("many", "function", "(a, b, c, d, ...)", 11)}


def test_java_and_cs_members(spark):
    f = workspace(spark, {
        "/w/A.java": "@Foo(\"x\") public abstract class A<T> extends B {\n  @Override public static <T> Map<String, T> go(@In(\"a\") Map<String, T> m,\n      int... n) {\n    return run(m);\n  }\n"
                     "  private void no() {}\n  public A(int x) {}\n  protected byte[] raw() { return null; }\n  private static class In {}\n}\ninterface I extends J {}",
        "/w/C.cs": "internal sealed class C : Base, IFoo\n{\n    public required Dictionary<string, int> Map { get; set; }\n    protected int Hidden { get; }\n    public int Field = 1;\n    public string Name => x.Name;\n"
                   "    protected internal static int Count\n    {\n        get;\n    }\n    [HttpGet(\"a\")] public async Task<List<int>> Go<T>([FromBody] Req r, int n = 1) {\n    }\n    private int no() { return 1; }\n}\npublic interface II : IBase {}"})
    got = {(r.path[3:], r.name, r.kind, r.signature, r.inherits, r.exported, r.ord) for r in symbols.symbols(f).collect()}
    assert got == {
        ("A.java", "A", "class", None, "B", True, 1), ("A.java", "go", "method", "(Map m, int... n)", None, True, 2), ("A.java", "raw", "method", "()", None, True, 8),
        ("A.java", "In", "class", None, None, False, 9), ("A.java", "I", "interface", None, "J", False, 11),
        ("C.cs", "C", "class", None, "Base", True, 1), ("C.cs", "Map", "property", ": Dictionary<string, int>", None, True, 3), ("C.cs", "Name", "property", ": string", None, True, 6),
        ("C.cs", "Count", "property", ": int", None, True, 7), ("C.cs", "Go", "method", "(Req r, int n)", None, True, 11), ("C.cs", "II", "interface", None, "IBase", True, 15)}


def test_data_models(spark):
    f = workspace(spark, {
        "/w/m.py": "class U(models.Model):\n    name = 1\n    age = 2\n    c = 3\n    d = 4\nclass Plain: pass", "/w/e.ts": "@Entity()\nexport class E {\n  id: number;\n}",
        "/w/E.java": "@Entity\n@Table(name=\"e\")\npublic class E {\n  private int id;\n}", "/w/R.cs": "[Table(\"r\")]\npublic class R {\n  public int Id;\n}\nrecord P(int A);", "/w/none.ts": None})
    got = {(r.file[3:], r.family, r.name, r.signature) for r in symbols.data_models(f).collect()}
    assert got == {
        ("m.py", "orm", "U", "name, age, c..."), ("e.ts", "orm", "E", "id"), ("E.java", "orm", "E", "id"), ("R.cs", "orm", "R", "Id"), ("R.cs", "record", "P", "int A")}


def test_clusters(spark):
    e = spark.createDataFrame([(s, t) for s in ("/w/i1.py", "/w/i2.py", "/w/i3.py") for t in ("/w/auth/a.py", "/w/auth/b.py", "/w/auth/config.py")], "source string, target string")
    assert [(r.name, r.files, r.score) for r in chains.module_clusters(e).collect()] == [("Auth", ["/w/auth/a.py", "/w/auth/b.py"], 6)]
    assert chains.module_clusters(e.limit(0)).count() == 0


def test_chains_fill_up(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {tuple(r.chain): r.starts_from_entry for r in chains.dependency_chains(e, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("a", "b", "c", "d"): True, ("b", "c", "a"): False, ("c", "a", "b"): False}


def test_frameworks(spark):
    names = lambda *p: {r.name for r in conventions.frameworks(workspace(spark, {"/w/" + x: "" for x in p})).collect()}
    assert names("manage.py", "urls.py") == {"Django"} and names("manage.py") == set()
    assert names("a/controllers/X.cs", "components/b.tsx") == {"ASP.NET Core", "React"}
    assert names("a/controller/A.java", "a/service/B.java") == {"Spring Boot"}


@pytest.mark.parametrize("kind", ["architecture", "map", "context"])
def test_reports(spark, kind, tmp_path):
    out = catalog.QUERIES[f"report_{kind}"](spark, "/root/testdata/sf0.001")
    rows = out.orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(1, len(rows) + 1)) and len(rows) <= report.BUDGETS[kind]
    assert rows[0].text == f"# {kind}" and sum(r.text.startswith("## ") for r in rows) >= 2
    report.write(out, str(tmp_path / kind))
    assert spark.read.text(str(tmp_path / kind)).count() == len(rows)


def test_ignore_rules(spark):
    rules = ["# none", "", "*.log", "build/", "!keep.log", "docs/**/x.md", "/top.txt"]
    want = {"a.log": True, "b/a.log": True, "keep.log": False, "build/x": True, "a/build/x": True, "builder": False, "docs/x.md": True, "docs/a/b/x.md": True, "top.txt": True, "a/top.txt": False}
    df = spark.createDataFrame([(k,) for k in want], "rel string")
    assert {r.rel: r.i for r in df.select("rel", ignore.is_ignored(F.col("rel"), rules).alias("i")).collect()} == want


def test_marked_dirs(spark):
    listing = lambda *p: spark.createDataFrame([(x,) for x in p], "rel string")
    assert ignore.excluded_dirs(listing("env/pyvenv.cfg", "venv/lib/python3.13/x.py", "lib/.buildinfo", "dist/a.js", "a/env/pyvenv.cfg"), ["node_modules"], always=["gen"], never=["venv"]) == ["gen", "node_modules", "env", "lib"]
    assert ignore.excluded_dirs(listing("dist/a.js", "package.json", "lib/a.js"), []) == ["dist"]


def test_fingerprint_state(spark, tmp_path):
    one = lambda size: text.fingerprint(spark.createDataFrame([("a", 1, size)], "path string, mtime long, size long"))
    folder = str(tmp_path / "state")
    assert text.is_stale(one(1), folder)
    text.write_state(one(1), folder)
    assert not text.is_stale(one(1), folder) and text.is_stale(one(2), folder)


def test_streaming_debounce_agrees_with_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = (changes.debounce(stream, "user_id", gap="30 minutes", late="1 hour").writeStream.format("memory").queryName("debounced").outputMode("append")
           .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    assert run.awaitTermination(120)
    last = events.agg(F.max("ts")).first()[0]
    batch = changes.debounce(events, "user_id", gap="30 minutes").filter(F.col("fires") <= F.lit(last) - F.expr("interval 1 hour"))
    got = spark.table("debounced")
    assert got.count() > 100 and set(map(tuple, got.collect())) == set(map(tuple, batch.collect()))


def test_empty_inputs(spark):
    f = workspace(spark, {"/w/a.py": "x"}).limit(0)
    e = spark.createDataFrame([], "source string, target string, type string, strength double")
    assert symbols.symbols(f).count() == symbols.data_models(f).count() == symbols.function_naming(f).count() == conventions.frameworks(f).count() == 0
    assert chains.dependency_chains(e).count() == chains.circular_pairs(e).count() == graph.hubs(e).count() == 0
