"""How often queries read, join and shuffle the largest table: by the plans that were run."""

import pytest

from tallyloom.plans import catalog
from tallyloom.sources.retail import retail_tx


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    return store, [found.apply(k).executionId() for k in range(found.size())]


def scans(spark, run, table):
    """How many scans of a table the plans have that run() executed (reused exchanges count once)."""
    before = set(executions(spark)[1])
    run()
    store, after = executions(spark)
    n = 0
    for k in after:
        if k not in before:
            nodes = store.planGraph(k).allNodes()
            n += sum("Scan parquet" in x.name() and table in x.desc() for x in (nodes.apply(i) for i in range(nodes.size())))
    return n


def collected(spark, name, small):
    return lambda: catalog.QUERIES[name](spark, small).collect()


@pytest.mark.parametrize("name", ["global_trees", "resolve_full", "answer_requests"])
def test_lines_are_read_once(spark, small, name):
    assert scans(spark, collected(spark, name, small), "l_orderkey") == 1


def test_lines_are_shuffled_twice_at_most(spark, small):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = retail_tx(spark, small)._jdf.queryExecution().sparkPlan()
        joins, todo = [], [(plan, 0)]
        while todo:
            node, over = todo.pop()
            over += "Join" in node.nodeName()
            if "Scan" in node.nodeName():
                joins.append((over, "l_orderkey" in node.toString()))
            children = node.children()
            todo += [(children.apply(i), over) for i in range(children.size())]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [n for n, lines in joins if lines] == [2] and len(joins) == 5
