"""Text embeddings for tilts: hashed TF-IDF and weighted means by holding."""

from __future__ import annotations

from pyspark.ml.feature import IDF, HashingTF, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf(df: DataFrame, text: str, features: int = 1 << 12) -> DataFrame:
    """Adds a sparse ``tfidf`` vector; null text counts as empty."""
    words = Tokenizer(inputCol="__text", outputCol="__words").transform(df.withColumn("__text", F.coalesce(text, F.lit(""))))
    counts = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features).transform(words)
    return IDF(inputCol="__tf", outputCol="tfidf", minDocFreq=2).fit(counts).transform(counts).drop("__text", "__words", "__tf")


def embedded(df: DataFrame, text: str, size: int = 16, features: int = 1 << 10) -> DataFrame:
    """Adds ``embedding``: the ``size`` leading principal components of hashed TF-IDF vectors, as an array.

    The matrix of products is ``features`` squared, whatever the number of texts.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    rows = tfidf(df, text, features)
    return PCA(k=size, inputCol="tfidf", outputCol="__p").fit(rows).transform(rows).withColumn("embedding", vector_to_array("__p")).select(*df.columns, "embedding")


def weighted_embedding(df: DataFrame, group: str, vector: str, weight: str, size: int) -> DataFrame:
    """The weighted mean vector of each group, as ``size`` sums in one aggregate."""
    w = F.col(weight)
    sums = df.groupBy(group).agg(F.array(*(F.sum(F.get(vector, F.lit(i)) * w) for i in range(size))).alias("s"), F.sum(w).alias("w"))
    return sums.select(group, F.transform("s", lambda x: F.try_divide(x, F.col("w"))).alias("embedding"))
