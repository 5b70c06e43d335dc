"""Joins of sides that grow with the files or links: none may send a whole side to the driver."""

import pytest

from loomgraph import catalog
from loomgraph.operators import chains, extract, graph, report, resolve, rules
from loomgraph.operators.conventions import symbol_index
from loomgraph.plans import bindings
from loomgraph.plans.state import ensure_checkpoints, keep
from loomgraph.sources.scan import with_parts

SF = "/root/testdata/sf0.001"


def sent_whole(df) -> bool:
    # the tables here are so small that the planner would send any side that it may
    return "Broadcast" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["links", "symbol_index"])
def test_queries_over_links(spark, name):
    assert not sent_whole(catalog.QUERIES[name](spark, SF))


@pytest.mark.parametrize("part", ["between", "degrees", "hubs", "hub_risk", "centrality", "blast_radius", "co_import_pairs", "mark_circular", "symbol_index", "call_links"])
def test_parts_of_reports(spark, part):
    ensure_checkpoints(spark)
    files = bindings.source_files(spark, SF)
    links = spark.createDataFrame([("/w/app/mod35.py", "/w/app/mod70.py", "import", 0.75, ["a"])], "source string, target string, type string, strength double, symbols array<string>")
    made = {
        "between": lambda: graph.between(links, files, graph.app()), "degrees": lambda: graph.degrees(links, files), "hubs": lambda: graph.hubs(links, 12, files),
        "hub_risk": lambda: graph.hub_risk(links, files), "centrality": lambda: graph.centrality(links, 8, files), "blast_radius": lambda: graph.blast_radius(links),
        "co_import_pairs": lambda: graph.co_import_pairs(links), "mark_circular": lambda: graph.mark_circular(links),
        "symbol_index": lambda: symbol_index(files, links, rules.integrations(files)), "call_links": lambda: resolve.call_links(extract.calls(files), files, True)}
    assert not sent_whole(made[part]())


def most_sent(spark, run) -> int:
    """Rows of the largest broadcast of all that ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    done = {x.executionId() for x in _seq(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = [0]
    for execution in _seq(store.executionsList()):
        if execution.executionId() not in done:
            values = store.executionMetrics(execution.executionId())
            for node in _seq(store.planGraph(execution.executionId()).allNodes()):
                if node.name() == "BroadcastExchange":
                    rows += [int(values.apply(m.accumulatorId()).replace(",", "")) for m in _seq(node.metrics()) if m.name() == "number of output rows" and values.contains(m.accumulatorId())]
    return max(rows)


def _seq(items):
    return [items.apply(i) for i in range(items.size())]


@pytest.mark.parametrize("part", ["dependency_chains", "module_clusters", "context"])
def test_context_sends_few_rows(spark, part):
    ensure_checkpoints(spark)
    # a long chain, and configuration files that are used by clusters without being one
    pairs = [(f"/w/app/m{i}.py", f"/w/app/m{i + 1}.py") for i in range(600)] + [(f"/w/app/m{i}.py", f"/w/config/c{j}.py") for i in range(2) for j in range(200)]
    links = spark.createDataFrame([(a, b, "import", 0.75, ["a"]) for a, b in pairs], "source string, target string, type string, strength double, symbols array<string>")
    files = with_parts(spark.createDataFrame([(p, "requests.get(u)") for p in sorted({x for pair in pairs for x in pair})], "path string, content string"), "/w")
    links = keep(links)  # the planner knows its size then
    made, got = {"dependency_chains": lambda: chains.dependency_chains(links), "module_clusters": lambda: chains.module_clusters(links), "context": lambda: report.build("context", files, links, "t", "/w")}, []
    # seven clusters of eight files and ten starts are the most that is meant to be sent
    assert most_sent(spark, lambda: got.extend(made[part]().collect())) <= 56
    # the most imported files lead nowhere, so the first sources start the chains
    walks = [[f"m{i + k}.py" for k in range(4)] for i in (0, 1, 10, 100, 101)]
    if part == "dependency_chains":
        assert [r.chain for r in got] == [[f"/w/app/{x}" for x in w] for w in walks]
    elif part == "module_clusters":
        assert [(r.name, r.files) for r in got] == [("app", sorted(f"/w/app/m{i}.py" for i in range(601))[:8])]
    else:
        assert {r.text for r in got if " -> " in r.text} == {"- " + " -> ".join(f"app/{x}" for x in w) for w in walks}


def test_context_joins_are_in_plans_of_its_sections(spark):
    out = catalog.QUERIES["report_context"](spark, SF)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
