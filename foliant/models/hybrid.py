"""Classes of tags from embeddings and rules: multinomial logistic regression over an embedding beside the rule class."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tags as X
from ..operators.sampling import stratified_split


def labelled(tags: DataFrame, labels: DataFrame, key: str = "shelf_canon", label: str = "human_category") -> DataFrame:
    """Tags that have a label; ValueError where the labels lack a column."""
    if missing := [c for c in (key, label) if c not in labels.columns]:
        raise ValueError(f"labels lack {', '.join(missing)}")
    return tags.join(labels.select(key, label), key)


def with_rule(tags: DataFrame, text: str = "shelf_canon") -> DataFrame:
    return tags.withColumn("rule_category", X.rule_class(F.col(text)))


def train(rows: DataFrame, label: str = "human_category", embedding: str = "embedding", rule: str = "rule_category", iterations: int = 1000) -> PipelineModel:
    """A pipeline fitted on rows with an embedding (array), a rule class and a label."""
    own = rows.withColumn("__v", array_to_vector(embedding))
    stages = [
        StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc"), StringIndexer(inputCol=rule, outputCol="__rule", handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["__rule"], outputCols=["__hot"], dropLast=False), VectorAssembler(inputCols=["__v", "__hot"], outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol="__label", family="multinomial", maxIter=iterations, predictionCol="__p", probabilityCol="__pr", rawPredictionCol="__raw"),
    ]
    return Pipeline(stages=stages).fit(own)


def predict(model: PipelineModel, rows: DataFrame, least: float = 0.7, embedding: str = "embedding") -> DataFrame:
    """rows with pred_category, confidence, and final_category: the prediction where it is sure enough, else UNKNOWN_OTHER."""
    names = F.array(*(F.lit(x) for x in model.stages[0].labels))
    scorer = PipelineModel([s for s in model.stages if s.uid != model.stages[0].uid])
    out = scorer.transform(rows.withColumn("__v", array_to_vector(embedding)))
    out = out.withColumn("pred_category", F.element_at(names, F.col("__p").cast("int") + 1)).withColumn("confidence", F.array_max(vector_to_array("__pr")))
    out = out.withColumn("final_category", F.when(F.col("confidence") >= least, F.col("pred_category")).otherwise(X.OTHER))
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def evaluate(predicted: DataFrame, label: str = "human_category") -> dict[str, DataFrame]:
    """report (class, n, precision, recall, f1) and confusion (label, predicted, n)."""
    cells = predicted.groupBy(F.col(label).alias("label"), F.col("pred_category").alias("predicted")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0))
    true, said = cells.groupBy("label").agg(F.sum("n").alias("n"), hit.alias("hits")), cells.groupBy("predicted").agg(F.sum("n").alias("said"))
    met = true.join(said, true.label == said.predicted, "left")
    precision, recall = F.col("hits") / F.coalesce("said", F.lit(1)), F.col("hits") / F.col("n")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"report": met.select(F.col("label").alias("class"), "n", precision.alias("precision"), recall.alias("recall"), f1.alias("f1")), "confusion": cells}


def run(tags: DataFrame, labels: DataFrame, key: str = "shelf_canon", embedding: str = "embedding", least: float = 0.7, share: float = 0.8) -> dict:
    """The whole classifier: rules, a stratified split of the labelled tags, training, evaluation on the rest, predictions for all tags."""
    ruled = with_rule(tags, key)
    known = stratified_split(labelled(ruled, labels, key), "human_category", key, share)
    model = train(known.filter("in_train"), embedding=embedding)
    return {"model": model, "evaluation": evaluate(predict(model, known.filter("not in_train"), least, embedding)), "predicted": predict(model, ruled, least, embedding)}


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def accuracy(predicted: DataFrame, label: str = "human_category") -> DataFrame:
    """One row: the share of rows whose prediction is their label."""
    return predicted.agg(F.avg((F.col(label) == F.col("pred_category")).cast("int")).alias("accuracy"))
