"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""

import os

import pytest

from compare import compare, duck
from quiltgraph.plans.catalog import ORACLE, QUERIES

DATA = os.environ.get("QUILTGRAPH_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, _, note = compare(spark, con, name, DATA)
    assert ok is not False, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", ["rrf_route", "candidate_pairs", "same_as_neighbours", "required_docs_all", "sparse_recall_topk"])
def test_no_all_pairs_join(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = QUERIES["required_docs_all"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "PushedFilters: [IsNotNull(p_size), LessThanOrEqual(p_size,45)" in plan


def test_common_names_are_limited_before_the_shuffle(spark):
    plan = QUERIES["candidate_groups"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_chunks_of_the_knowledge_are_made_once(spark):
    """Texts are cut once for extraction, summaries and evidence; links are written only where several turns read them."""
    from quiltgraph.plans import base

    know = base.knowledge(spark, DATA, links=False)
    assert "chunk_order_index" in know.chunks.columns
    plan = know.chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "Generate" not in plan
