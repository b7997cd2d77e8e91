"""Vector operators: cosine divergence, linear CKA, balanced accuracy, nearest-centroid and logistic probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def linear_cka(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by.., n, cka) between two vector columns of aligned rows, in covariance form.

    Cross-products of dimensions are summed map-side: what is shuffled is dims x dims sums per task, not rows.
    """
    by = by or []
    pair = lambda a, b: rows.select(*by, F.posexplode(a).alias("i", "u"), F.col(b)).select(*by, "i", "u", F.posexplode(b).alias("j", "v"))

    def squared(a: str, b: str, name: str) -> DataFrame:
        u, v = F.col("u").cast("double"), F.col("v").cast("double")
        sums = pair(a, b).groupBy(*by, "i", "j").agg(F.sum(u * v).alias("uv"), F.sum(u).alias("su"), F.sum(v).alias("sv"), F.count(F.lit(1)).alias("n"))
        c = F.col("uv") - F.col("su") * F.col("sv") / F.col("n")
        return sums.groupBy(*by).agg(F.sum(c * c).alias(name), F.max("n").alias("n"))

    xy, xx, yy = squared(x, y, "xy"), squared(x, x, "xx").drop("n"), squared(y, y, "yy").drop("n")
    joined = xy.join(xx, by).join(yy, by) if by else xy.crossJoin(xx).crossJoin(yy)  # single rows
    return joined.select(*by, "n", F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("cka"))


def cka_matrix(rows: DataFrame, item: list[str], by: list[str], rendering: str, vector: str) -> DataFrame:
    """(by.., a, b, n, cka) for each pair of renderings, over the items that both have; null for fewer than three.

    An item's renderings are gathered to one map and paired within the row, a < b.
    """
    maps = rows.groupBy(*by, *item).agg(F.map_from_entries(F.collect_list(F.struct(rendering, vector))).alias("m"))
    names = F.array_sort(F.map_keys("m"))
    pairs = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"), F.element_at("m", a).alias("x"), F.element_at("m", b).alias("y")))))
    each = maps.select(*by, F.explode(pairs).alias("p")).select(*by, "p.a", "p.b", "p.x", "p.y")
    return linear_cka(each, "x", "y", [*by, "a", "b"]).withColumn("cka", F.when(F.col("n") > 2, F.col("cka")))


def balanced_accuracy(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Mean over true classes of the recall."""
    by = by or []
    recall = rows.groupBy(*by, truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.groupBy(*by).agg(F.count(F.lit(1)).alias("classes"), F.avg("recall").alias("balanced_accuracy"))


def majority_label(rows: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """The most frequent label, of equally frequent ones the smallest."""
    counts = rows.groupBy(*(by or []), label).count()
    return counts.groupBy(*(by or [])).agg(F.min_by(label, F.struct(-F.col("count"), F.col(label))).alias("majority"))


def world_split(unit: Column, test_fraction: float, seed: int) -> Column:
    """True for units of the test side, by a hash of seed and unit."""
    share = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed).cast("string"), unit.cast("string")), 256), 1, 12), 16, 10).cast("double") / float(16**12)
    return share < test_fraction


def logistic_probe(train: DataFrame, test: DataFrame, features: str, label: str, regularization: float = 0.01) -> DataFrame:
    """test with `predicted`: standardised features, multinomial logistic regression with L2."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    ready = lambda df: df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>"))).withColumn("_y", F.col(label).cast("double"))
    scale = StandardScaler(inputCol="_v", outputCol="_s", withMean=True)
    fit = LogisticRegression(featuresCol="_s", labelCol="_y", predictionCol="_p", family="multinomial", regParam=regularization, elasticNetParam=0.0)
    model = Pipeline(stages=[scale, fit]).fit(ready(train))
    return model.transform(ready(test)).withColumn("predicted", F.col("_p").cast(train.schema[label].dataType)).select(*test.columns, "predicted")
