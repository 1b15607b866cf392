"""Topics: k-means over vectors, quality by centroid silhouettes, labels by a given function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators import search, sequences

# The least mean silhouette of topics, points of a fit, rounds, versions that are kept.
LEAST_SILHOUETTE, SAMPLE, ROUNDS, VERSIONS = 0.18, 20_000, 30, 2
#: Names the way of clustering: results of another one are not taken over.
ALGORITHM = "kmeans-stride-2"


def centroids(points: DataFrame) -> DataFrame:
    """(topic_id, centre): means of each topic's vectors."""
    spread = points.select("topic_id", F.posexplode("embedding").alias("i", "x"))
    means = spread.groupBy("topic_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))


def silhouettes(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds silhouette: (b - a) / max(a, b) of the distances to the own and the nearest other centre. Centres, one per topic, come as one array."""
    every = centres.agg(F.collect_list(F.struct("topic_id", "centre")).alias("_all"))
    far = points.crossJoin(F.broadcast(every)).withColumn("_d", F.transform("_all", lambda c: F.struct((c["topic_id"] == F.col("topic_id")).alias("own"), F.sqrt(search.squared_distance(F.col("embedding"), c["centre"])).alias("d"))))
    nearest = lambda own: F.array_min(F.transform(F.filter("_d", lambda x: x["own"] == own), lambda x: x["d"]))
    a, b = nearest(True), nearest(False)
    return far.withColumn("silhouette", F.when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)).drop("_all", "_d")


def representatives(points: DataFrame, centres: DataFrame, most: int) -> DataFrame:
    """(topic_id, item_id, distance, place): the points nearest to their topic's centre."""
    near = points.join(F.broadcast(centres), "topic_id").select("topic_id", "item_id", F.round(F.sqrt(search.squared_distance(F.col("embedding"), F.col("centre"))), 6).alias("distance"))
    return sequences.top_per_group(near, ["topic_id"], [F.col("distance"), F.col("item_id")], most)


@dataclass
class Clustering:
    assignments: DataFrame
    k: int
    silhouette: float
    candidates: list[tuple[int, float]]
    reused: str | None = None  # the version whose result it is


def assigned(points: DataFrame, centres: DataFrame) -> DataFrame:
    """Points with topic_id, that of the nearest centre, of equals the least, and its distance. Centres, one per topic, come as one array."""
    every = centres.agg(F.collect_list(F.struct("topic_id", "centre")).alias("_all"))
    near = F.array_min(F.transform("_all", lambda c: F.struct(F.sqrt(search.squared_distance(F.col("embedding"), c["centre"])).alias("d"), c["topic_id"].alias("t"))))
    return points.crossJoin(F.broadcast(every)).withColumn("_n", near).withColumn("topic_id", F.col("_n.t")).withColumn("distance", F.col("_n.d")).drop("_all", "_n")


def refined(points: DataFrame, centres: DataFrame, rounds: int = 2) -> DataFrame:
    """Centres (topic_id, centre) moved to the means of all the points that are nearest to them, so many times; one without points goes."""
    spark = points.sparkSession
    for _ in range(rounds):
        moved = centroids(assigned(points.select("item_id", "embedding"), centres)).collect()  # one row for each topic
        centres = spark.createDataFrame([(r["topic_id"], r["centre"]) for r in moved], "topic_id int, centre array<double>")
    return centres


def input_hash(points: DataFrame, *settings: object) -> str:
    """A name for the points (item_id, embedding), whatever their order, and the settings of a run."""
    row = points.agg(F.count("*"), F.bit_xor(F.xxhash64("item_id", "embedding")), F.sum(F.hash("item_id", "embedding").cast("long"))).first()
    return hashlib.sha256(repr((tuple(row), settings)).encode()).hexdigest()


def reusable(runs: DataFrame, input_hash_: str, model_id: str, algorithm: str):
    """The newest completed run of the same input, model and algorithm, or None. runs: version, status, algorithm, model_id, input_hash, completed_at, k, silhouette."""
    same = runs.filter((F.col("status") == "completed") & (F.col("algorithm") == algorithm) & (F.col("model_id") == model_id) & (F.col("input_hash") == input_hash_))
    return same.orderBy(F.desc("completed_at"), F.desc("version")).first()


def cluster(points: DataFrame, least_k: int = 8, most_k: int = 32, step: int = 4, seed: int = 7, runs: DataFrame | None = None, held: DataFrame | None = None, model_id: str = "") -> Clustering:
    """(item_id, topic_id) with the k whose silhouette on an even sample is best; none good enough is one topic of all.

    points: item_id, embedding. The fit of each k is on SAMPLE points at even
    strides of their ids; the centres of the best are then moved by all points,
    and all are assigned. runs and held (version, item_id, topic_id): a run of
    the same points and settings is taken over, not made again.
    """
    if runs is not None and held is not None:
        settings = (least_k, most_k, step, seed)
        before = reusable(runs, input_hash(points, *settings), model_id, ALGORITHM)
        if before is not None:
            own = held.filter(F.col("version") == before["version"]).select("item_id", "topic_id")
            return Clustering(own, before["k"], before["silhouette"], [], before["version"])
    usable = points.filter(F.col("embedding").isNotNull()).select("item_id", "embedding").withColumn("features", array_to_vector("embedding"))
    sample = sequences.stride_sample(usable, ["item_id"], SAMPLE).persist()
    tried = []
    try:
        n = sample.count()
        for k in range(least_k, most_k + 1, step):
            if k < 2 or k > n:
                continue
            fitted = KMeans(k=k, seed=seed, maxIter=ROUNDS, featuresCol="features", predictionCol="topic_id").fit(sample)
            own = fitted.transform(sample).select("item_id", "topic_id", "embedding")
            tried.append((k, silhouettes(own, centroids(own)).agg(F.avg("silhouette")).first()[0], fitted))
    finally:
        sample.unpersist()
    best = max(tried, key=lambda t: (t[1], -t[0]), default=None)
    shown = [(k, s) for k, s, _ in tried]
    if best is None or best[1] < LEAST_SILHOUETTE:
        return Clustering(usable.select("item_id", F.lit(0).alias("topic_id")), 1, best[1] if best else 0.0, shown)
    spark = points.sparkSession
    fitted = spark.createDataFrame([(n, [float(x) for x in c]) for n, c in enumerate(best[2].clusterCenters())], "topic_id int, centre array<double>")
    return Clustering(assigned(usable, refined(usable, fitted)).select("item_id", "topic_id"), best[0], best[1], shown)


def labels(topics: list[dict], label: Callable[[list[str], list[str]], str]) -> list[dict]:
    """Labels of topics (topic_id, texts, terms) by a function; a label has 1 to 60 characters on one line."""
    out = []
    for topic in topics:
        text = label(topic["texts"], topic["terms"]).strip()
        if not 1 <= len(text) <= 60 or "\n" in text:
            raise ValueError(f"topic {topic['topic_id']}: a label of {len(text)} characters")
        out.append({"topic_id": topic["topic_id"], "label": text})
    return out


def latest_versions(runs: DataFrame, most: int = VERSIONS) -> DataFrame:
    """The newest runs that are kept."""
    return sequences.top_per_group(runs.withColumn("_one", F.lit(1)), ["_one"], [F.desc("created_at"), F.desc("version")], most).drop("_one", "place")


def by_month(assignments: DataFrame, items: DataFrame) -> DataFrame:
    return assignments.join(items.select("item_id", "occurred_at"), "item_id").groupBy("topic_id", F.date_format("occurred_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("messages"))


def share(assignments: DataFrame) -> DataFrame:
    by = assignments.groupBy("topic_id").agg(F.count("*").alias("messages"))
    return by.withColumn("share", F.col("messages") / F.sum("messages").over(Window.partitionBy()))


def told(run_silhouette: float, topics: DataFrame, labels: DataFrame) -> bool:
    """Whether a run's topics are shown: good enough, and each with a label."""
    return run_silhouette >= LEAST_SILHOUETTE and not topics.join(labels, "topic_id", "left_anti").limit(1).count()


def by_project(assignments: DataFrame, items: DataFrame) -> DataFrame:
    return assignments.join(items.select("item_id", "workspace"), "item_id").groupBy("workspace", "topic_id").agg(F.count("*").alias("messages"))
