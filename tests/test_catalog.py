import pytest

from quillion.plans import catalog

from .corpora import topic_docs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of two interleaved topics, and no benchmark table."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(7 * k, f"{title}\n{body}") for k, (_, title, body) in enumerate(topic_docs(120))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_bisection_orders_the_documents(spark, folder):
    order = catalog.bp_reorder(spark, folder).collect()
    assert sorted(r.doc_id for r in order) == [7 * k for k in range(120)]
    assert sorted(r.new_id for r in order) == list(range(120))
    cost = catalog.bp_reorder_cost(spark, folder).first()
    assert cost.permutation and cost.n_docs == 120 and cost.cost_after < 0.85 * cost.cost_before
