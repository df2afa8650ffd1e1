"""TF-IDF with readability features and logistic regression, cross validation, gate."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import lexical as L
from quarry.functions import readability as R
from quarry.operators.splits import ranked

FEATURES = ["fre", "fkg", "gunning_fog", "avg_word_length", "words_per_sentence", "complex_share", "syllables_per_word", "technical", "technical_density", "patterns", "acronyms"]


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the eleven features, in their fixed order; syllables are those of the first hundred words."""
    out = R.counts(df, text, first_words=100).withColumns({"_few": F.col("n_syllables"), "_terms_n": L.term_count(text)}).drop("n_syllables", "n_complex", "n_words", "n_sentences", "n_letters", "n_long")
    out = R.counts(out, text)
    n = F.greatest(F.lit(1), F.least(F.lit(100), F.col("n_words"))).cast("double")
    short = F.length(F.regexp_replace(text, "^\\s+|\\s+$", "")) < 10
    made = {
        "fre": R.flesch(), "fkg": R.kincaid(), "gunning_fog": R.fog(), "avg_word_length": R.word_length(), "words_per_sentence": F.col("n_words") / F.col("n_sentences"),
        "complex_share": F.col("n_long") / F.greatest(F.lit(1), F.col("n_words")), "syllables_per_word": F.col("_few") / n, "technical": F.col("_terms_n").cast("double"),
        "technical_density": F.lit(100.0) * F.col("_terms_n") / F.greatest(F.lit(1), F.col("n_words")), "patterns": L.pattern_count(text).cast("double"), "acronyms": L.acronyms(text, 5).cast("double"),
    }
    blank = {"fre": 0.0, "fkg": 20.0, "gunning_fog": 20.0, "avg_word_length": 0.0, "words_per_sentence": 0.0, "complex_share": 0.0, "syllables_per_word": 0.0}
    return out.select(*df.columns, *[(F.when(short, F.lit(blank[k])).otherwise(v) if k in blank else v).alias(k) for k, v in made.items()])


def _terms(text: str) -> list:
    return [
        RegexTokenizer(inputCol=text, outputCol="_t", pattern="[^\\p{L}\\p{N}]+", minTokenLength=2), StopWordsRemover(inputCol="_t", outputCol="_u"), NGram(inputCol="_u", outputCol="_b", n=2),
        SQLTransformer(statement="SELECT *, concat(_u, _b) AS _terms FROM __THIS__"),
    ]


def _vocabulary(terms: DataFrame, most: int, min_df: int, max_df: float) -> list[str]:
    """The most frequent of ``_terms`` within the bounds; as CountVectorizer finds them, which holds all terms of all texts in memory for a share as a bound."""
    once = lambda a, n, df: F.transform(a, lambda t: F.struct(t.alias("term"), F.lit(n).alias("n"), F.lit(df).alias("df")))
    each = terms.select(F.explode(F.concat(once(F.col("_terms"), 1, 0), once(F.array_distinct("_terms"), 0, 1))).alias("x")).select("x.*")
    rows = terms.count()
    counts = each.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).filter((F.col("df") >= min_df) & (F.col("df") <= (max_df if max_df >= 1.0 else max_df * rows)))
    return [r.term for r in counts.orderBy(F.desc("n"), "term").limit(most).select("term").collect()]


def weighted(df: DataFrame, label: str = "label") -> DataFrame:
    """``df`` with weights that balance the classes: rows over classes times the class's rows."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_own"))
    whole = sizes.agg(F.sum("_own").alias("_n"), F.count(F.lit(1)).alias("_k"))
    weights = sizes.crossJoin(F.broadcast(whole)).select("_label", (F.col("_n") / (F.col("_k") * F.col("_own"))).alias("weight"))  # one row
    return df.join(weights, F.col(label) == F.col("_label"), "left").drop("_label")


def fit(df: DataFrame, text: str = "text", label: str = "label", vocabulary: int = 10_000, min_df: int = 2, max_df: float = 0.95, c: float = 1.0, iterations: int = 200) -> PipelineModel:
    """Stages from text and features to ``probability``.

    Term weights are tf * (idf + 1), of length 1; the regression has an L2 penalty of 1 / (c * sum of weights) on coefficients as they are.
    """
    labelled = df.filter(F.col(label).isNotNull())
    stages = PipelineModel(_terms(text))
    words = _vocabulary(stages.transform(labelled.select(text)), vocabulary, min_df, max_df)
    counted = PipelineModel([*stages.stages, CountVectorizerModel.from_vocabulary(words, inputCol="_terms", outputCol="_tf")])
    # Read by each stage in turn; lost parts are made again. Without the texts and their terms, which are many times as large,
    # and in as many parts as there are cores: the regression goes over them some hundreds of times.
    ready = counted.transform(weighted(features(labelled, text), label)).select(label, "weight", "_tf", *FEATURES)
    ready = ready.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(ready).idf
    plus_one = ElementwiseProduct(inputCol="_tf", outputCol="_tfidf", scalingVec=Vectors.dense([x + 1.0 for x in idf]))
    rest = PipelineModel([plus_one, Normalizer(inputCol="_tfidf", outputCol="_norm"), VectorAssembler(inputCols=["_norm", *FEATURES], outputCol="_features", handleInvalid="keep")])
    total = ready.agg(F.sum("weight")).first()[0] or 1.0
    regression = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="weight", maxIter=iterations, tol=1e-4, regParam=1.0 / (c * total), standardization=False)
    model = PipelineModel([*counted.stages, *rest.stages, regression.fit(rest.transform(ready))])
    ready.unpersist()
    return model


def score(model: PipelineModel, df: DataFrame, text: str = "text", out: str = "p_plain") -> DataFrame:
    """``df`` with the probability of class 1; null texts stay, with null."""
    ready = features(df, text).withColumns({"_null": F.col(text).isNull(), text: F.coalesce(text, F.lit(""))}).withColumn("weight", F.lit(1.0))
    p = vector_to_array(F.col("probability"))[1]
    made = model.transform(ready).withColumn(out, F.when(~F.col("_null"), p)).withColumn(text, F.when(~F.col("_null"), F.col(text)))
    return made.select(*df.columns, out)


def gate(scored: DataFrame, text: str = "text", p: str = "p_plain", least: float = 0.7, chars: int = 50) -> DataFrame:
    return scored.filter((F.length(text) >= chars) & (F.col(p) >= least))


def folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: str = "42") -> DataFrame:
    """``df`` with ``fold``: ranks by hash within each label, modulo k."""
    return ranked(df, id_col, [label], seed).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def cross_validate(df: DataFrame, id_col: str, text: str, label: str, k: int = 5, **options) -> DataFrame:
    """Class metrics of each fold by a model of the others; nothing of a fold reaches its model."""
    from quarry.operators.stats import class_metrics

    cut, out = folds(df, id_col, label, k), None
    for n in range(k):
        model = fit(cut.filter(F.col("fold") != n), text, label, **options)
        part = score(model, cut.filter(F.col("fold") == n), text).withColumn("pred", (F.col("p_plain") >= 0.5).cast("int"))
        row = class_metrics(part, label, "pred").select(F.lit(n).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out
