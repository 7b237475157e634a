"""k-means over features of results, and diverse selections."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.results import by


def normalised(df: DataFrame, features: list[str]) -> DataFrame:
    """z_<feature>: nulls as 0, over the population deviation, or 1 where that is about 0."""
    filled = df.withColumns({f"_{f}": F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    ends = filled.agg(*[g(f"_{f}").alias(f"{n}_{f}") for f in features for n, g in (("m", F.avg), ("s", F.stddev_pop))])
    out = filled.crossJoin(ends)
    scaled = {f"z_{f}": (F.col(f"_{f}") - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") < 1e-10, 1.0).otherwise(F.col(f"s_{f}")) for f in features}
    return out.withColumns(scaled).drop(*[f"_{f}" for f in features], *[f"m_{f}" for f in features], *[f"s_{f}" for f in features])


def cluster(df: DataFrame, features: list[str], k: int, rounds: int = 300, seed: int = 42, starts: int = 1) -> tuple[DataFrame, float]:
    """``df`` with cluster and distance (squared, to its centre), and the inertia; the best of ``starts`` seeds.  2 <= k <= n/2."""
    n = df.count()
    if not 2 <= k <= n / 2:
        raise ValueError(f"{k} clusters of {n} rows")
    z = VectorAssembler(inputCols=[f"z_{f}" for f in features], outputCol="_v").transform(normalised(df, features))
    models = [KMeans(k=k, maxIter=rounds, seed=seed + i, featuresCol="_v", predictionCol="cluster").fit(z) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    centres = [[float(x) for x in c] for c in best.clusterCenters()]
    centre = F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in centres]), F.col("cluster") + 1)
    squares = [F.pow(F.col(f"z_{f}") - F.get(centre, i), 2.0) for i, f in enumerate(features)]
    total = squares[0]
    for s in squares[1:]:
        total = total + s
    out = best.transform(z).withColumn("distance", total).drop("_v", *[f"z_{f}" for f in features])
    return out, best.summary.trainingCost


def elbow(df: DataFrame, features: list[str], ks: range, **how) -> list[tuple[int, float]]:
    """(k, inertia) of each k that is possible."""
    n = df.count()
    return [(k, cluster(df, features, k, **how)[1]) for k in ks if 2 <= k <= n / 2]


def cluster_summary(clustered: DataFrame, metrics: list[str]) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count("*").alias("n"), *[g(m).alias(f"{n}_{m}") for m in metrics for n, g in (("avg", F.avg), ("std", F.stddev_pop))])


def representatives(clustered: DataFrame, key: str = "config_id") -> DataFrame:
    """The member nearest to each centre."""
    return clustered.groupBy("cluster").agg(F.min_by(key, F.struct("distance", key)).alias(key), F.min("distance").alias("distance"))


def optimal_k(candidates: int, wanted: int, least: int = 2, most: int = 10) -> int:
    return max(least, min(most, wanted // 2, candidates // 2))


def diverse(df: DataFrame, n: int, features: list[str], rank: str = "sharpe", key: str = "config_id") -> DataFrame:
    """``n`` rows: of the 2n best by ``rank``, clustered, each cluster gives its rounded share, its best first."""
    best = df.orderBy(*by(rank, False, key)).limit(2 * n)
    size = best.count()
    if size < 4:
        return best.limit(n)
    found, _ = cluster(best, features, optimal_k(size, n))
    counts = found.groupBy("cluster").count()
    share = F.greatest(F.lit(1), F.round(F.col("count") * n / size)).cast("int")
    ranked = found.join(counts, "cluster").withColumns({"_r": F.row_number().over(Window.partitionBy("cluster").orderBy(*by(rank, False, key))), "_share": share})
    # members within their cluster's share first; then the best of the rest, until there are n
    return ranked.orderBy((F.col("_r") > F.col("_share")).asc(), *by(rank, False, key)).limit(n).drop("_r", "_share", "count")


#: Features that clusters are made on: performance, and robustness besides.
FEATURES = ["sharpe", "cagr", "max_drawdown"]


def diverse_by_sharpe(df: DataFrame, n: int, features: list[str] | None = None) -> DataFrame:
    return diverse(df, n, features or FEATURES, "sharpe")


def diverse_by_robust_score(df: DataFrame, n: int, features: list[str] | None = None) -> DataFrame:
    """Of results by configuration with a robust_score."""
    return diverse(df, n, features or ["mean_sharpe", "win_ratio", "robust_score"], "robust_score")
