"""Clusters, components and forests by pyspark.ml on array columns."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.functions import chem


def _with_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def clusters(df: DataFrame, vector: str, k: int = 8, seed: int = 7) -> DataFrame:
    """``df`` with ``cluster``."""
    source = _with_vector(df, vector)
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(source).transform(source).drop("__v")


def components(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """``df`` with ``pca``, the first k principal components."""
    source = _with_vector(df, vector)
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(source).transform(source).withColumn("pca", vector_to_array("__p")).drop("__v", "__p")


def composition_forest(train: DataFrame, test: DataFrame, label: str, formula: str = "formula", trees: int = 50, seed: int = 7) -> DataFrame:
    """``test`` with ``probability``: a random forest on shares, element count and atomic-number moments."""
    p = chem.parse_formula(F.col(formula))

    def made(df: DataFrame) -> DataFrame:
        z = chem.z_moments(F.col("__p"))
        f = F.concat(chem.fraction_vector(F.col("__p"), chem.SYMBOLS), F.array(F.size("__p").cast("double"), z["mean"], z["std"], z["least"].cast("double"), z["most"].cast("double")))
        return df.withColumn("__p", p).where("__p is not null").withColumn("__v", array_to_vector(F.transform(f, lambda x: F.coalesce(x, F.lit(0.0)))))

    forest = RandomForestClassifier(featuresCol="__v", labelCol="__y", numTrees=trees, seed=seed, probabilityCol="__prob")
    fitted = forest.fit(made(train).withColumn("__y", F.col(label).cast("double")))
    return fitted.transform(made(test)).withColumn("probability", F.get(vector_to_array("__prob"), F.lit(1))).select(*test.columns, "probability")
