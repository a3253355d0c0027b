"""Language identification by a multilayer perceptron over character n-grams (Spark ML)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import char_windows, clean, let

FEATURES, HIDDEN, ITERATIONS, SEED = 3000, 64, 800, 42
#: Labelled texts a query trains on at most, drawn by a hash of the id: Spark ML multiplies dense rows, so all texts of a large collection are out of reach.
TEXTS = 600


def windows(texts: DataFrame) -> DataFrame:
    """(lang, text): the overlapping windows of the training texts."""
    return texts.select("lang", F.explode(char_windows(F.col("text"))).alias("text"))


def _grams(texts: DataFrame) -> DataFrame:
    def grams(body: Column) -> Column:
        sizes = F.sequence(F.lit(1), F.least(F.lit(3), F.length(body)))
        return F.when(F.length(body) > 0, F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.length(body) - k + 1), lambda i: F.substring(body, i, k)))))

    return texts.withColumn("grams", F.coalesce(let(clean(F.col("text")), grams), F.array().cast("array<string>")))


def train(texts: DataFrame, features: int = FEATURES, hidden: int = HIDDEN, iterations: int = ITERATIONS) -> tuple[PipelineModel, list[str]]:
    """(model, languages) from texts (lang, text). Layers are the vocabulary, `hidden` and the languages."""
    rows = _grams(windows(texts))
    prepare = Pipeline(stages=[StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc"), CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features), IDF(inputCol="tf", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features")]).fit(rows)
    ready = prepare.transform(rows)
    size, labels = len(prepare.stages[1].vocabulary), prepare.stages[0].labels
    net = MultilayerPerceptronClassifier(layers=[size, hidden, max(2, len(labels))], maxIter=iterations, seed=SEED).fit(ready)
    return PipelineModel([*prepare.stages[1:], net]), list(labels)


def save(model: PipelineModel, labels: list[str], path: str) -> None:
    """Writes the model and its languages below one folder, in place of what is there."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame(list(enumerate(labels)), "place int, lang string").coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    rows = spark.read.schema("place int, lang string").json(f"{path}/labels").orderBy("place").collect()  # one row a language
    return PipelineModel.load(f"{path}/model"), [r["lang"] for r in rows]


def predict(documents: DataFrame, model: PipelineModel, labels: list[str]) -> DataFrame:
    """(doc_id, predicted, probability): the most probable language; texts without letters get probability 0 and the first language."""
    scored = model.transform(_grams(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    chances = vector_to_array("probability")
    names = F.array(*[F.lit(x) for x in labels])
    empty = F.size("grams") == 0
    top = F.array_max(chances)
    return scored.select("doc_id", F.when(empty, F.lit(labels[0])).otherwise(F.get(names, (F.array_position(chances, top) - 1).cast("int"))).alias("predicted"), F.when(empty, 0.0).otherwise(top).alias("probability"))
