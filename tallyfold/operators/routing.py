"""Routing of questions: class and difficulty by text classifiers, and answer ranking by boosted trees.

Training rows are the caller's: (question, label).
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .attributions import mean_attributions
from .written import written

SEED = 42
#: Rows that a task of a tree's training holds.
DEALT = 1 << 18


def _features(size: int, longest: int = 3) -> list:
    """Weighted n-grams of words up to longest, to unit length."""
    stages = [RegexTokenizer(inputCol="question", outputCol="__w1", pattern=r"\W+")]
    stages += [NGram(n=n, inputCol="__w1", outputCol=f"__w{n}") for n in range(2, longest + 1)]
    stages += [CountVectorizer(inputCol=f"__w{n}", outputCol=f"__c{n}", vocabSize=size) for n in range(1, longest + 1)]
    stages += [VectorAssembler(inputCols=[f"__c{n}" for n in range(1, longest + 1)], outputCol="__c"), IDF(inputCol="__c", outputCol="__t"), Normalizer(inputCol="__t", outputCol="features")]
    return stages


def _trained(data: DataFrame, size: int, classifier) -> PipelineModel:
    index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(data)
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[index.setHandleInvalid("keep"), *_features(size), classifier.setLabelCol("__y"), back]).fit(data)


def train_router(data: DataFrame) -> PipelineModel:
    """A decision tree of depth 10 over 2000 n-grams."""
    return _trained(data, 2000, DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=2, seed=SEED))


def train_difficulty(data: DataFrame, c: float = 1.0) -> PipelineModel:
    """Multinomial logistic regression over 1500 n-grams."""
    return _trained(data, 1500, LogisticRegression(maxIter=1000, regParam=1.0 / (c * max(data.count(), 1)), family="multinomial"))


def classify(model: PipelineModel, questions: DataFrame, default: str) -> DataFrame:
    """question_id, predicted, probability; an empty question gets the default."""
    q = questions.withColumn("question", F.coalesce("question", F.lit(""))).withColumn("label", F.lit(default))
    out = model.transform(q)
    empty = F.trim("question") == ""
    return out.select("question_id", F.when(empty, default).otherwise(F.col("predicted")).alias("predicted"), F.when(empty, 1.0).otherwise(F.array_max(vector_to_array("probability"))).alias("probability"))


def _compared(a: list[str], b: list[str]) -> list[Column]:
    return [(F.col(x).cast("double") - F.col(y).cast("double")).alias(x) for x, y in zip(a, b, strict=True)]


def train_ranker(graded: DataFrame, group: str, grade: str, features: list[str], rounds: int = 40, every: bool = False) -> PipelineModel:
    """Boosted trees over differences of features: which of two candidates of a group has the better grade.

    With every, each candidate of a group meets all those graded below it, both ways round;
    equal candidates of a group are one row of the join. Without it, it meets the one graded
    next below it, so that pairs grow with the rows. Equal pairs are one row, weighted by their
    number. Null features count as 0. The model is saved and loaded as any pipeline
    (save_ranker, load_ranker).
    """
    rows = graded.where(F.col(grade).isNotNull()).na.fill(0.0, features)
    low = [f"__low_{f}" for f in features]
    if every:
        each = rows.groupBy(group, grade, *features).agg(F.count("*").alias("__k"))
        worse = each.select(group, F.col(grade).alias("__low"), *(F.col(f).alias(n) for f, n in zip(features, low, strict=True)), F.col("__k").alias("__m"))
        pairs = each.join(worse, group).where(F.col(grade) > F.col("__low")).withColumn("__n", F.col("__k") * F.col("__m"))
    else:
        w = Window.partitionBy(group).orderBy(F.desc(grade), *features)
        below = rows.select(group, grade, *features, F.lead(F.struct(F.col(grade).alias("__low"), *(F.col(f).alias(n) for f, n in zip(features, low, strict=True)))).over(w).alias("__next"))
        pairs = below.select("*", "__next.*").where(F.col(grade) > F.col("__low")).withColumn("__n", F.lit(1))
    won = written(pairs.select(*_compared(features, low), "__n").groupBy(*features).agg(F.sum("__n").cast("double").alias("__n")))
    lost = won.select(*((-F.col(f)).alias(f) for f in features), "__n", F.lit(0.0).alias("label"))
    both = _dealt(won.withColumn("label", F.lit(1.0)).unionByName(lost), [*features, "label"])
    trees = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.2, seed=SEED, weightCol="__n")
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees]).fit(both)


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows in parts of about DEALT, however many there are, since training holds a part in memory."""
    return rows.repartition(max(1, -(-rows.count() // DEALT)), *by).sortWithinPartitions(*by)


def save_ranker(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_ranker(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def ranked(model: PipelineModel, candidates: DataFrame, group: str, key: str, features: list[str]) -> DataFrame:
    """group, key, score, rank: the mean probability of beating the group's other candidates; alone it is 1. Ties by key.

    The candidates of a group are the answers to one question, a handful.
    """
    rows = candidates.na.fill(0.0, features).select(group, key, *features)
    other = rows.select(group, F.col(key).alias("__other"), *(F.col(f).alias(f"__{f}") for f in features))
    met = rows.join(other, group).where(F.col(key) != F.col("__other")).select(group, key, *_compared(features, [f"__{f}" for f in features]))
    wins = model.transform(met).groupBy(group, key).agg(F.round(F.avg(vector_to_array("probability")[1]), 9).alias("score"))
    scores = rows.select(group, key).join(wins, [group, key], "left").select(group, key, F.coalesce("score", F.lit(1.0)).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key)))


def train_forest(rows: DataFrame, features: list[str], trees: int = 10, depth: int = 3) -> tuple[RandomForestClassificationModel, DataFrame]:
    """A forest of shallow trees over features (label: 0 or 1), and rows with their vector."""
    placed = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED).fit(placed), placed


def feature_importance(rows: DataFrame, key: str, features: list[str], top: int = 10) -> DataFrame:
    """feature, importance, rank: mean Shapley attributions of a forest of ten shallow trees."""
    model, placed = train_forest(_dealt(rows, [key]), features)
    return mean_attributions(model, placed, key, features, top)
