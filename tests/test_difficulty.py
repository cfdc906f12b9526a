"""The difficulty classifier on questions it was not trained on."""

from tallyfold.operators import routing as G


def test_difficulty_of_new_questions(spark):
    kinds = {"easy": ["what was revenue in {}", "state net income of {}"], "medium": ["compare revenue with costs in {}", "compare margins with those of {}"], "hard": ["explain why margins fell while revenue grew from {}", "explain the drivers of debt since {}"]}
    rows = [(f"{k}{y}{i}", q.format(y), k) for k, qs in kinds.items() for y in range(2000, 2012) for i, q in enumerate(qs)]
    d = spark.createDataFrame(rows, "question_id string, question string, label string")
    model = G.train_difficulty(d.where("question not like '%2010' and question not like '%2011'").select("question", "label"))
    new = d.where("question like '%2010' or question like '%2011'")
    got = G.classify(model, new.select("question_id", "question"), "medium").join(new, "question_id")
    assert got.where("predicted = label").count() >= 0.9 * got.count()
    assert G.classify(model, spark.createDataFrame([("x", None)], "question_id string, question string"), "medium").first().predicted == "medium"
