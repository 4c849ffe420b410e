"""Evidence of datasets: what is dealt by dataset stays there."""

from __future__ import annotations

from mapquarry.operators import evidence as E
from mapquarry.plans.catalog import Catalog
from mapquarry.plans.queries import QUERIES


def test_links_are_dealt_by_dataset_once(spark, sf):
    c = Catalog(spark, sf)
    for links in (c.has_topic, c.has_keyword, c.pending):
        plan = links.groupBy("dataset_id").count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(dataset_id") == 1 and "Exchange hashpartitioning(dataset_id#" in plan and ", p_" not in plan.split("Exchange hashpartitioning(dataset_id")[1].split(")")[0]


def test_formats_by_dataset_equal_formats_by_resource(spark, sf):
    c = Catalog(spark, sf)
    ids = spark.range(100, 140).withColumnRenamed("id", "dataset_id")
    by_dataset = E.subgraph_edges(ids, [], c.has_resource, c.dataset_format)
    assert sorted(map(tuple, by_dataset.collect())) == sorted(map(tuple, E.subgraph_edges(ids, [], c.has_resource, c.has_format).collect()))


def test_filtered_subgraph_spells_no_edges_of_others(spark, sf):
    """Datasets are filtered before their edges are made: no hash of an edge is shuffled."""
    plan = QUERIES["subgraph_filter"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "edge_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_a_dataset_is_one_list_of_links(spark):
    """Sets of each relation, nulls left out, by one buffer a dataset."""
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    x = spark.createDataFrame([(1, "q"), (1, "p"), (1, "q"), (1, None), (3, "z")], "dataset_id long, entity_id string")
    got = E.bundles(d, {"x": x, "y": x.where("entity_id = 'p'")})
    assert sorted(map(tuple, got.collect())) == [(1, "a", "p,q", "p"), (2, "b", "", "")]
    assert "collect_set" not in got._jdf.queryExecution().executedPlan().toString()
