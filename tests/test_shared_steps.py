"""Steps that a query's later passes share are worked out once."""

from tallyfold.plans import documents, feeds


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_questions_of_routers_are_read_from_a_table(spark, sf):
    d = feeds._labelled(spark, sf)
    assert "Join" not in plan(d) and "Aggregate" not in plan(d)
    assert d.count() > 0 and d.columns == ["question_id", "question", "label", "difficulty"]


def test_pages_are_parsed_once_for_all_chunks(spark, sf):
    assert "MapInArrow" not in plan(documents.fallback_chunks(spark, sf))
