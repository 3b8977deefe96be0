"""Text classification: TF-IDF features, classifiers, calibration and explanation, on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Features:
    """Settings of the features; the defaults are those of the training pipeline."""

    max_features: int = 200_000
    max_words: int = 2
    min_df: float = 2
    max_df: float = 0.98
    hashed: bool = False
    buckets: int = 1 << 20
    options: dict = field(default_factory=dict)


def terms_stages(settings: Features, text: str) -> list:
    """Words of two characters or more and their n-grams in one column, terms."""
    words = RegexTokenizer(inputCol=text, outputCol="_w1", pattern=r"(?U)\b\w\w+\b", gaps=False, toLowercase=False)
    grams = [NGram(n=n, inputCol="_w1", outputCol=f"_w{n}") for n in range(2, settings.max_words + 1)]
    joined = ", ".join(f"_w{n}" for n in range(1, settings.max_words + 1))
    return [words, *grams, SQLTransformer(statement=f"SELECT * EXCEPT ({joined}), concat({joined}) AS terms FROM __THIS__")]


def feature_pipeline(settings: Features, text: str = "text") -> Pipeline:
    """Stages to a vector column, features: counts weighted by smooth idf (plus one) and scaled to length 1."""
    if settings.hashed:
        return Pipeline(stages=[*terms_stages(settings, text), HashingTF(numFeatures=settings.buckets, inputCol="terms", outputCol="_tf"), Normalizer(inputCol="_tf", outputCol="features")])
    counts = CountVectorizer(vocabSize=settings.max_features, minDF=settings.min_df, maxDF=settings.max_df, inputCol="terms", outputCol="_tf")
    return Pipeline(stages=[*terms_stages(settings, text), counts, IDF(inputCol="_tf", outputCol="_idf")])


def fit_features(df: DataFrame, settings: Features = Features(), text: str = "text") -> PipelineModel:
    """The fitted feature pipeline. Spark's idf is ln((n+1)/(df+1)); one is added to every weight before scaling."""
    model = feature_pipeline(settings, text).fit(df)
    if settings.hashed:
        return model
    idf = model.stages[-1].idf.toArray() + 1.0
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
    return PipelineModel(stages=[*model.stages[:-1], weigh, Normalizer(inputCol="_tfidf", outputCol="features")])


def classifier(kind: str = "logreg", **options):
    """An estimator on features and label_index."""
    common = {"featuresCol": "features", "labelCol": "label_index"}
    made = {
        "logreg": lambda: LogisticRegression(maxIter=options.pop("maxIter", 100), family="multinomial", **common, **options),
        "random_forest": lambda: RandomForestClassifier(numTrees=options.pop("numTrees", 300), seed=options.pop("seed", 42), **common, **options),
        "boosting": lambda: OneVsRest(classifier=GBTClassifier(maxIter=options.pop("maxIter", 50), **options), **common),
        "bayes": lambda: NaiveBayes(**common, **options),
        "svm": lambda: OneVsRest(classifier=LinearSVC(**options), **common),
        "perceptron": lambda: MultilayerPerceptronClassifier(**common, **options),
    }
    if kind not in made:
        raise ValueError(f"unknown classifier {kind}; known are {sorted(made)}")
    return made[kind]()


def train(df: DataFrame, kind: str = "logreg", settings: Features = Features(), text: str = "text", label: str = "label", **options) -> PipelineModel:
    """One model from text to predicted label: label index (alphabetical), features, classifier, label names.

    Rows with a null label are left out."""
    labels = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip").fit(df)
    features = fit_features(df, settings, text)
    ready = features.transform(labels.transform(df))
    fitted = classifier(kind, **options).fit(ready)
    names = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels.labels)
    return PipelineModel(stages=[features, fitted, names])


def classes(model: PipelineModel) -> list[str]:
    return model.stages[-1].getLabels()


def predict(model: Transformer, df: DataFrame) -> DataFrame:
    """``df`` with prediction, predicted_label and, where the classifier has them, probabilities as an array."""
    out = model.transform(df)
    return out.withColumn("probabilities", vector_to_array("probability")) if "probability" in out.columns else out


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def calibrate(scored: DataFrame, score: str, positive: str, method: str = "sigmoid"):
    """A model from a raw score to a probability: 'sigmoid' (one-dimensional logistic) or 'isotonic'."""
    rows = scored.select(F.col(score).cast("double").alias("_score"), F.col(positive).cast("double").alias("_y"))
    if method == "isotonic":
        return Pipeline(stages=[VectorAssembler(inputCols=["_score"], outputCol="_v"), IsotonicRegression(featuresCol="_v", labelCol="_y", predictionCol="calibrated")]).fit(rows)
    if method != "sigmoid":
        raise ValueError("method must be sigmoid or isotonic")
    return Pipeline(stages=[VectorAssembler(inputCols=["_score"], outputCol="_v"), LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r")]).fit(rows)


def calibrated(model: PipelineModel, scored: DataFrame, score: str) -> DataFrame:
    out = model.transform(scored.withColumn("_score", F.col(score).cast("double")))
    if "calibrated" not in out.columns:
        out = out.withColumn("calibrated", vector_to_array("_p")[1])
    return out.drop("_score", "_v", "_p", "_c", "_r")


def linear_features(model: PipelineModel, class_index: int, k: int = 20, lowest: bool = False) -> list[tuple[str, float]]:
    """The k terms with the highest (or lowest) weight for a class; the size of a vocabulary, not of the data."""
    vocabulary = next(s for s in model.stages[0].stages if hasattr(s, "vocabulary")).vocabulary
    weights = model.stages[1].coefficientMatrix.toArray()[class_index]
    order = weights.argsort()[:k] if lowest else weights.argsort()[::-1][:k]
    return [(vocabulary[i], float(weights[i])) for i in order]


def tree_features(model: PipelineModel, k: int = 20) -> list[tuple[str, float]]:
    vocabulary = next(s for s in model.stages[0].stages if hasattr(s, "vocabulary")).vocabulary
    weights = model.stages[1].featureImportances.toArray()
    return [(vocabulary[i], float(weights[i])) for i in weights.argsort()[::-1][:k]]


def smooth_tfidf(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, weight) of every term of every row, as columns only: tf (ln((n+1)/(df+1)) + 1), scaled to length 1."""
    n = df.count()
    tf = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = tf.join(df_, "term").withColumn("w", F.col("tf") * (F.ln((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0))
    length = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return weighed.join(length, key).select(key, "term", F.round(F.col("w") / F.col("length"), 6).alias("weight"))


def weights(df: DataFrame, key: str, features: str = "features") -> DataFrame:
    """(key, place, weight) of the entries of sparse vectors that aren't zero."""
    raw = F.unwrap_udt(F.col(features))
    return df.select(key, F.explode(F.arrays_zip(raw["indices"].alias("place"), raw["values"].alias("weight"))).alias("x")).select(key, "x.place", "x.weight")


def term_weights(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of the features of a fitted pipeline with a vocabulary; the vocabulary is joined as a table."""
    terms = next(s for s in model.stages if hasattr(s, "vocabulary")).vocabulary
    names = df.sparkSession.createDataFrame(list(enumerate(terms)), "place int, term string")
    return weights(model.transform(df), key).join(names, "place").select(key, "term", "weight")


def term_importance(model: PipelineModel, spark, class_index: int | None = None) -> DataFrame:
    """(term, weight) of every term for a class of a linear model, or of a tree model as a whole, as a table."""
    terms = next(s for s in model.stages[0].stages if hasattr(s, "vocabulary")).vocabulary
    fitted = model.stages[1]
    found = fitted.featureImportances.toArray() if class_index is None else fitted.coefficientMatrix.toArray()[class_index]
    return spark.createDataFrame([(t, float(w)) for t, w in zip(terms, found)], "term string, weight double")
