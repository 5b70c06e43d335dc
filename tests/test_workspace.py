"""Workspaces, reports, clusters and change events, against plain Python and small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph import catalog, engine
from loomgraph.functions import paths as P
from loomgraph.operators import chains, extract, graph, report, resolve, rules, symbols, text
from loomgraph.plans.state import ensure_checkpoints
from loomgraph.sources.scan import ScanCache, excluded_names, scan, snapshot, with_parts
from loomgraph.streaming import changes


def workspace(spark, files: dict):
    return with_parts(spark.createDataFrame(list(files.items()), "path string, content string"), "/w")


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, "import", 0.75) for a, b in pairs], "source string, target string, type string, strength double")


def groups(pairs):
    """The strongly connected groups, by reachability of all pairs."""
    reach = {}
    for a, b in pairs:
        reach.setdefault(a, set()).add(b)
        reach.setdefault(b, set())
    for k in reach:
        for a in reach:
            if k in reach[a]:
                reach[a] |= reach[k]
    return {(n, min(m for m in reach if m in reach[n] and n in reach[m]), sum(m in reach[n] and n in reach[m] for m in reach)) for n in reach if n in reach[n] and any(m != n and m in reach[n] and n in reach[m] for m in reach)}


@pytest.mark.parametrize("small", [0, 1000])
def test_strong_components(spark, monkeypatch, small):
    ensure_checkpoints(spark)
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(small)
    n = 18 if small else 5  # the distributed search takes seconds for each step
    ring = [f"n{rng.randrange(10**6)}" for _ in range(n)]
    pairs = list(zip(ring, ring[1:] + ring[:1])) + [(f"a{i}", ring[i]) for i in range(3)] + [("x", "y"), ("y", "x"), ("y", "z"), ("z", "z")] + [(f"r{rng.randrange(n)}", f"r{rng.randrange(n)}") for _ in range(n + 3)]
    got = {tuple(r) for r in graph.strong_components(edges(spark, pairs)).collect()}
    assert got == groups([p for p in pairs if p[0] != p[1]])
    assert graph.strong_components(edges(spark, [("a", "a")])).count() == 0


@pytest.mark.parametrize("split", [3, 5000])
def test_co_import_pairs_of_large_importers(spark, monkeypatch, split):
    monkeypatch.setattr(graph, "SPLIT", split)
    rng = random.Random(1)
    pairs = {(f"i{rng.randrange(12)}", f"t{rng.randrange(30)}") for _ in range(150)} | {("i0", f"t{k}") for k in range(30)}
    by = {}
    for a, b in pairs:
        by.setdefault(b, set()).add(a)
    want = {(a, b, len(by[a] & by[b])) for a in by for b in by if a < b and len(by[a] & by[b]) >= 2}
    assert {tuple(r) for r in graph.co_import_pairs(edges(spark, pairs)).collect()} == want


def clusters(pairs, n=7):
    """The greedy walk over all seeds, then the best; names still their own."""
    by = {}
    for a, b in pairs:
        if a != b:
            by.setdefault(b, set()).add(a)
    near = {a: {b: by[a] & by[b] for b in sorted(by) if a < b and len(by[a] & by[b]) >= 2} for a in sorted(by)}
    used, out = set(), []
    for seed in sorted((a for a in near if near[a]), key=lambda a: (-sum(map(len, near[a].values())), a)):
        if seed in used:
            continue
        best = sorted(near[seed].items(), key=lambda x: (-len(x[1]), x[0]))[:7]
        used |= {seed, *dict(best)}
        files = sorted(f for f in [seed, *dict(best)] if "config" not in f)[:8]
        if len(files) >= 2:
            shared = set().union(*(s for _, s in best))
            out.append(((lambda d: d[:1].upper() + d[1:])(files[0].split("/")[-2]), files, sorted(shared)[:3], len(shared), sum(len(s) for _, s in best)))
    return sorted(out, key=lambda c: (-c[4], c[0]))[:n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_module_clusters(spark, seed):
    rng = random.Random(seed)
    # many seeds, several of one total; some configuration files
    pairs = {(f"/w/im/i{rng.randrange(40)}.py", f"/w/d{k % 23}x/{'config' if k % 9 == 0 else 't'}{k}.py") for k in (rng.randrange(120) for _ in range(900))}
    want = clusters(pairs)
    got = chains.module_clusters(edges(spark, pairs)).collect()
    assert [(r.files, r.shared, r.score) for r in got] == [(f, n, s) for _, f, _, n, s in want]
    assert [r.reason for r in got] == ["Imported together by " + ", ".join(first) + (f" (+{n - 3} more)" if n > 3 else "") for _, _, first, n, _ in want]
    assert len({r.name for r in got}) == len(got) and all(r.name.startswith(w[0]) for r, w in zip(got, want))


def test_folders_fill_few_clusters(spark):
    pairs = [(f"/w/i{i}.py", f"/w/auth/{t}.py") for i in range(3) for t in "ab"] + [("/w/solo.py", f"/w/util/u{i}.py") for i in range(9)]
    got = {r.name: (r.files, r.score) for r in chains.module_clusters(edges(spark, pairs)).collect()}
    assert got == {"Auth": (["/w/auth/a.py", "/w/auth/b.py"], 3), "util": ([f"/w/util/u{i}.py" for i in range(8)], 9), "w": (["/w/i0.py", "/w/i1.py", "/w/i2.py", "/w/solo.py"], 4)}


def test_names_of_equal_clusters():
    assert [c[0] for c in chains._apart([("A", ["x/a/f"], 1), ("A", ["y/b/f"], 1), ("B", ["b/f"], 1)])] == ["A (a)", "A (b)", "B"]
    assert [c[0] for c in chains._apart([("A", ["x/a/f"], 1), ("A", ["y/a/f"], 1)])] == ["A #1", "A #2"]


def test_merged_links_keep_symbols_and_lines(spark):
    rows = [("a", "b", "import", 0.8, ["x", "y"], [1, 4]), ("b", "a", "circular", 0.6, ["y", "z"], [2]), ("c", "a", "import", 0.7, ["q"], [9])]
    e = spark.createDataFrame(rows, "source string, target string, type string, strength double, symbols array<string>, lines array<int>")
    got = {(r.source, r.target): (r.type, round(r.strength, 6), r.bidirectional, r.symbols, r.lines) for r in graph.merge_reverse(e).collect()}
    assert got == {("a", "b"): ("import", 1.0, True, ["x", "y", "z"], [1, 4, 2]), ("c", "a"): ("import", 0.7, False, ["q"], [9])}


def test_impact_by_class(spark):
    f = workspace(spark, {p: "x" for p in ("/w/a.py", "/w/tests/t.py", "/w/node_modules/n.js", *(f"/w/u{i}.py" for i in range(6)))})
    e = edges(spark, [(f"/w/u{i}.py", t) for i in range(6) for t in ("/w/a.py", "/w/tests/t.py", "/w/node_modules/n.js")] + [("/w/node_modules/n.js", "/w/a.py"), ("/w/u1.py", "/w/u0.py")])
    one = lambda target: graph.impact_summary(e, f, target).first()
    r = one("/w/a.py")
    assert (r.dependents_count, r.hub_risk, len(r.top_dependents)) == (6, "HIGH", 5)
    assert [(x.file, x.dependent_count) for x in r.top_dependents][:2] == [("/w/u0.py", 1), ("/w/u1.py", 0)]
    assert (one("/w/tests/t.py").hub_risk, one("/w/node_modules/n.js").dependents_count, one("/w/node_modules/n.js").hub_risk) == ("MEDIUM", 0, "LOW")
    assert tuple(one("/w/nowhere.py"))[1:] == (0, [], "LOW")


def test_focus_on_an_unknown_file(spark):
    nodes, links, counts = graph.focused_graph(edges(spark, [("a", "b")]), "zz")
    assert [tuple(r) for r in nodes.select("file", "imports", "exports", "calls", "total", "is_hub", "importance").collect()] == [("zz", 0, 0, 0, 0, True, 0)]
    assert links.count() == 0 and tuple(counts.first()) == (0, 0)


def test_circular_links_are_no_imports(spark):
    e = edges(spark, [("a", "b")]).union(spark.createDataFrame([("b", "c", "circular", 1.0), ("b", "d", "call", 0.6)]))
    got = {r.file: (r.imports, r.exports, r.calls, r.total, r.circular, r.is_hub, r.importance) for r in graph.focus_metrics(e, "b").collect()}
    assert got == {"a": (1, 0, 0, 1, False, False, 1), "b": (0, 1, 1, 2, True, True, 7), "c": (0, 0, 0, 0, True, True, 5), "d": (0, 0, 0, 0, False, False, 0)}


def test_callers_of_symbols(spark):
    f = workspace(spark, {"/w/m.py": "def f(): pass", **{f"/w/a/b/c{i}.py": "x" for i in range(7)}, "/w/tests/t.py": "x"})
    links = spark.createDataFrame([(p, "/w/m.py", "import", ["other"]) for p in [f"/w/a/b/c{i}.py" for i in range(7)] + ["/w/tests/t.py"]], "source string, target string, type string, symbols array<string>")
    own = symbols.symbols(f.filter("path = '/w/m.py'"))
    assert symbols.callers(own, links, f).first().used_in == [f"b/c{i}.py" for i in range(5)] + ["(+2 more)"]
    named = links.withColumn("type", F.lit("circular"))
    assert symbols.callers(own, named, f).count() == 0
    assert symbols.callers(own, named.withColumn("symbols", F.array(F.lit("f"))), f).count() == 1


def test_bare_calls_give_no_links(spark):
    f = workspace(spark, {"/w/a.py": "util.go(1)\ngo(2)\nutil.go(3)\nutil.miss()", "/w/util.py": "def go(x): pass"})
    assert resolve.call_links(extract.calls(f), f).count() == 0
    got = resolve.call_links(extract.calls(f), f, True).first()
    assert (got.source, got.target, got.strength, got.symbols, got.lines) == ("/w/a.py", "/w/util.py", 0.7, ["go"], [1, 3])


def test_links_in_dictionary_order(spark):
    e = edges(spark, [("b", "a"), ("B", "a"), ("a", "c"), ("C", "a"), ("a", "B")])
    assert [(r.source, r.target) for r in resolve.in_order(e).collect()] == [("a", "B"), ("a", "c"), ("b", "a"), ("B", "a"), ("C", "a")]


FILES = {
    "app/main.py": "from fastapi import FastAPI\nfrom app.models import User\nimport app.util as u\n@app.get('/')\ndef get_it(a, b): pass\n",
    "app/models.py": "from .util import helper\n@dataclass\nclass User:\n    name: str\n    age: int\nCACHE = {}\n",
    "app/util.py": "from app.models import User\nimport requests\nrequests.get('u')\ndef helper(x): pass\n",
    "app/views.py": "from app.models import User\nfrom app.util import helper\ndef post(self): pass\n",
    "app/jobs.py": "from app.models import User\nfrom app.util import helper\nimport boto3\n",
    "tests/test_app.py": "from app.main import get_it\n", "vendor/x.py": "import y\n", "migrations/keep.gen.ts": "export const a = 1\n"}


@pytest.fixture
def folder(tmp_path):
    for name, body in FILES.items():
        p = tmp_path / "w" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    return str(tmp_path / "w")


def test_engine(spark, folder, tmp_path):
    e = engine.Engine(spark).load(folder)
    links = {(r.source[len(folder) + 1 :], r.target[len(folder) + 1 :]): (r.type, r.bidirectional) for r in e.links().collect()}
    assert links[("app/models.py", "app/util.py")] == ("circular", True) and links[("app/main.py", "app/models.py")] == ("import", False)
    assert [r.path[len(folder) + 1 :] for r in e.entry_points().collect()] == ["app/main.py", "app/views.py"]
    assert {(r.a[-9:], r.b[-7:]) for r in e.cycles().collect()} == {("models.py", "util.py")}
    assert e.impact(f"{folder}/app/models.py").first().dependents_count == 3
    assert e.hubs().count() and e.degrees().count() == e.files().count() == 7 and e.blast_radius().count() and e.symbols().count() >= 5
    assert {r.message for r in e.findings("integration").collect()} == {"HTTP client: requests", "Cloud SDK: AWS"}
    assert {r.message for r in e.findings("global_state").collect()} == {"Module-level mutable state"}
    assert e.findings("data_model").first().name == "User" and e.clusters().count() >= 1 and e.chains().count() >= 1
    assert tuple(e.stats().first())[0] == 7 and len(e.focus(f"{folder}/app/util.py")) == 3
    out = tmp_path / "_kb"
    assert e.build_kb(str(out)) == [] and not out.exists()
    out.mkdir()
    assert e.build_kb(str(out), "now") == ["architecture", "map", "context"]
    read = {k: [r.value for r in spark.read.text(str(out / k)).collect()] for k in ("architecture", "map", "context")}
    assert read["architecture"][0] == "# architecture" and "Files: 7 | Links: 8 | Cycles: 1" in read["architecture"]
    assert "- app/main.py FastAPI (1) high" in read["architecture"] and "- app/models.py <-> app/util.py" in read["architecture"] and "- app/models.py: Module-level mutable state" in read["architecture"]
    assert "Test files: 1 | Folders: tests" in read["architecture"]
    assert "- app/models.py: User (name, age)" in read["map"] and any(x.startswith("- app/util.py | helper(x) | function | app/jobs.py, app/") for x in read["map"])
    assert "- http: app/util.py HTTP client: requests" in read["context"] and any(x.startswith("- app/main.py -> ") for x in read["context"])
    assert not text.is_stale(e.fingerprint(), str(out / "fingerprint"))


def test_hub_details_add_up(spark):
    names = [f"/w/a{i}.py" for i in range(12)]
    f = workspace(spark, {n: "x" for n in names})
    links = edges(spark, [(n, names[0]) for n in names[1:]] + [(names[2], names[1]), (names[3], names[1]), (names[4], names[1])]).withColumn("symbols", F.array().cast("array<string>"))
    lines = [r.text for r in report.build("architecture", f, links, "t", "/w").orderBy("ord").collect()]
    assert "1 | a0.py | out 0 | importers 11 | High" in lines
    at = lines.index("**1. a0.py** reaches 14 files: 11 direct, 3 indirect")
    assert lines[at + 1 : at + 7] == [f"  - a{i}.py" for i in (1, 10, 11, 2, 3)] + ["  - ...and 6 more"]


@pytest.mark.parametrize("kind", ["architecture", "map", "context"])
def test_reports_hold_their_invariants(spark, kind):
    rows = catalog.QUERIES[f"report_{kind}"](spark, "/root/testdata/sf0.001").orderBy("ord").collect()
    lines = [r.text for r in rows]
    assert len(lines) <= report.BUDGETS[kind] and "\\" not in "".join(lines)
    heads = [x for x in lines if x.startswith("#")]
    assert len(heads) == len(set(heads)) and lines[-1] == "Generated: 0"
    shown = [x for x in lines if x.startswith("- ") and kind == "architecture"]
    assert len(shown) == len(set(shown))


def test_map_counts_function_names_of_all_files(spark):
    files = {f"/w/app/m{i:03}.py": "def get_a(x): pass\ndef get_b(x): pass" for i in range(120)} | {f"/w/app/z{i}.ts": f"function setX{i}(a) {{}}\nconst isA = (a) => a" for i in range(9)}
    files |= {"/w/app/z.java": "  public int hasAny() {}", "/w/tests/test_a.py": "def update_a(x): pass", "/w/app/zz.py": "def getter(x): pass"}
    none = edges(spark, []).withColumn("symbols", F.array().cast("array<string>"))
    lines = [r.text for r in report.build("map", workspace(spark, files), none, "t", "/w").orderBy("ord").collect()]
    at = lines.index("## Function names")
    assert lines[at + 1 : at + 6] == ["- get: 240 get_a", "- is: 9 isA", "- set: 9 setX0", "- has: 2 hasAny", ""]


def test_map_query_agrees_with_plain_counts_of_names(spark):
    sf, want = "/root/testdata/sf0.001", {"get": 0, "handle": 0}
    for r in catalog.code(spark, sf).filter("file_class = 'app'").select("ext").collect():
        if r.ext != ".go":  # a Java method counts twice
            want["handle" if r.ext == ".ts" else "get"] += 2 if r.ext == ".java" else 1
    lines = [r.text for r in catalog.QUERIES["report_map"](spark, sf).orderBy("ord").collect()]
    at = lines.index("## Function names")
    assert sum(want.values()) > 100 and [x.split()[1:3] for x in lines[at + 1 : at + 3]] == [[f"{v}:", str(want[v])] for v in ("get", "handle")]


def test_empty_reports(spark):
    f = workspace(spark, {"/w/a.py": "x"})
    none = edges(spark, []).withColumn("symbols", F.array().cast("array<string>"))
    for files in (f, f.limit(0)):
        for kind in report.BUDGETS:
            lines = [r.text for r in report.build(kind, files, none, "t", "/w").orderBy("ord").collect()]
            assert lines[0] == f"# {kind}" and lines[-1] == "Generated: t"


def test_scan_options(spark, folder, tmp_path):
    names = lambda **k: {r.rel for r in scan(spark, folder, **k).collect()}
    assert "vendor/x.py" not in names() and "vendor/x.py" in names(never=["vendor"])
    assert names(always=["app"]) == {"tests/test_app.py", "migrations/keep.gen.ts"}
    assert names(settings=["**/migrations", "**/tests/**", "*.x"]) == {n for n in FILES if n.startswith("app/")}
    (tmp_path / "w" / "env").mkdir()
    (tmp_path / "w" / "env" / "pyvenv.cfg").write_text("x")
    (tmp_path / "w" / "env" / "m.py").write_text("x")
    assert "env/m.py" in names() and "env/m.py" not in names(markers=True) and "env/m.py" in names(markers=True, never=["env"])
    assert excluded_names(spark, folder, always=["zz"], never=["vendor"])[0] == "zz"
    assert P.settings_names(["**/node_modules", "*.js", "**/*.gen.ts", "**/a*b", "dist/**", "ab"]) == ["node_modules", ".js", ".gen.ts", "dist"]


def test_scan_cache(spark, folder, tmp_path):
    cache = ScanCache(spark)
    first = cache.files(folder)
    before, n = snapshot(first).first().fingerprint, first.count()
    (tmp_path / "w" / "new.py").write_text("x")
    assert cache.files(folder) is first
    cache.dirty(folder)
    assert cache.files(folder).count() == n + 1 and snapshot(cache.files(folder)).first().fingerprint != before


def test_sections_of_marked_text(spark):
    rows = [("", "S\nnew\nE\n"), ("a", "a\n\nS\nnew\nE\n"), ("aS\nold\nEb", "aS\nnew\nEb"), ("E x S", "E x S\n\nS\nnew\nE\n")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r.x for r in df.select(text.merge_section(F.col("t"), F.lit("new"), "S", "E").alias("x")).collect()] == [w for _, w in rows]
    cut = spark.createDataFrame([("a\nS\nx\nE\n\nb",), ("none",), ("S x",)], "t string").select(text.remove_section(F.col("t"), "S", "E").alias("x")).collect()
    assert [r.x for r in cut] == ["ab", "none", "S x"]


def test_triggers_by_mode(spark):
    at = "2024-01-01 00:00:"
    rows = [("w", "a.py", at + "00", "edit", 1, 5, 0, 0), ("w", "a.py", at + "05", "edit", 2, 5, 0, 0), ("w", "a.py", at + "06", "save", 0, 0, 0, 0), ("w", "a.txt", at + "07", "save", 0, 0, 0, 0), ("w", "/w/node_modules/x/a.py", at + "08", "save", 0, 0, 0, 0), ("w", "b.ts", at + "40", "delete", None, None, None, None)]
    e = changes.tracked(spark.createDataFrame(rows, changes.SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")))
    got = lambda mode: [(str(r.started)[17:], str(r.fires)[17:], r.events) for r in changes.triggers(e, mode).orderBy("started").collect()]
    assert got("onSave") == [("05", "08", 2), ("40", "42", 1)] and got("idle") == [("00", "36", 3), ("40", "10", 1)] and got("off") == []
    with pytest.raises(ValueError):
        changes.triggers(e, "never")


def test_stale_only_once_until_fresh(spark):
    rows = [(1, i, s) for i, s in enumerate([True, True, False, None, True, True, False, True])]
    df = spark.createDataFrame(rows, "k int, ts int, stale boolean")
    assert [r.ts for r in changes.stale_transitions(df, "k", "ts", F.col("stale")).orderBy("ts").collect()] == [0, 4, 7]


def test_change_stream_regenerates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"workspace":"w","path":"a.py","ts":"2024-01-01T00:00:00Z","kind":"save"}\n{"workspace":"w","path":"a.md","ts":"2024-01-01T00:00:09Z","kind":"save"}\n')
    seen = []
    run = changes.Regenerator(spark, lambda batch: seen.append(batch.count()))
    query = changes.change_source(spark, str(tmp_path / "in")).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(60) and seen == [1] and (run.done, run.dropped) == (1, 0)
    with run.busy:  # a run is on: the trigger is dropped, not kept
        run(spark.range(1).toDF("x"))
    assert (run.done, run.dropped) == (1, 1)
    run(spark.range(0).toDF("x"))
    run.cancel()
    assert run.done == 1


def test_token_patterns():
    assert rules.token_pattern("fetch ('") == r"fetch\s*\('" and rules.token_pattern("a.(b|c)") == r"a\.(?:b|c)" and rules.token_pattern("new  W (") == r"new\s+W\s*\("


def test_entry_order(spark):
    f = workspace(spark, {"/w/b/web.py": "from flask import Flask\n@app.get('/')\n@app.get('/b')", "/w/a/web.py": "from flask import Flask\n@app.get('/')", "/w/run.py": "if __name__ == '__main__': go()", "/w/p/index.ts": "export * from './a'", "/w/main.py": "x", "/w/x.config.js": "module.exports = 1", "/w/config/y.js": "1"})
    assert [r.path for r in rules.entry_points(f).orderBy(*rules.entry_order()).collect()] == ["/w/b/web.py", "/w/a/web.py", "/w/main.py", "/w/x.config.js", "/w/run.py", "/w/p/index.ts"]
