"""Vectors: all-pairs similarity by blocks, neighbours, centroids, coherence, spread, silhouette."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearby import nearest_rows, similar_pairs

#: Rows of a block of the all-pairs grid.
BLOCK = 2048


def unit(vector: str = "embedding"):
    """The vector as doubles of length one; not-a-number and infinite entries count as 0, a zero vector stays."""
    v = F.transform(F.col(vector), lambda x: F.when(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), 0.0).otherwise(x.cast("double")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def _grid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Both sides of every pair of blocks, block a <= block b: df's columns with side and the pair. Each row is sent once per block; tasks hold two blocks."""
    blocks = max(1, -(-df.count() // BLOCK))
    own = F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int")
    return df.select(*columns, own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")).select(*columns, "own", F.least("own", "other").alias("ba"), F.greatest("own", "other").alias("bb"))


def similarity_edges(df: DataFrame, threshold: float) -> DataFrame:
    """(i, j, sim): pairs i < j of df(idx, embedding) with cosine of threshold or more."""
    return similar_pairs(df, threshold)


def similarity_graph(df: DataFrame, threshold: float = 0.65, max_nodes: int | None = 500, max_edges: int | None = 2000) -> DataFrame:
    """(source, target, weight): the thresholded graph of df(idx, embedding, label). With more than max_nodes rows only the first max_nodes rows that are not noise have edges; of more than max_edges edges the heaviest stay. None lifts a cap."""
    nodes = df
    if max_nodes is not None and df.limit(max_nodes + 1).count() > max_nodes:
        nodes = df.where("label <> -1").orderBy("idx").limit(max_nodes)
    edges = similarity_edges(nodes, threshold).select(F.col("i").alias("source"), F.col("j").alias("target"), F.bround("sim", 4).alias("weight"))
    return edges if max_edges is None else edges.orderBy(F.desc("weight"), "source", "target").limit(max_edges)


def neighbours(df: DataFrame, k: int, threshold: float | None = None, ties: str = "low") -> DataFrame:
    """(i, j, sim, rank): each row's k nearest others by cosine; equal ones by lower or higher idx."""
    return nearest_rows(df, k, threshold, ties)


def centroids(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(label, k, c): components of each cluster's mean direction, of length one; noise has none. Sums are partial in the map tasks."""
    mean = df.where("label <> -1").select("label", F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("m"))
    norm = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(F.broadcast(norm), "label").select("label", "k", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")).alias("c"))


def centroid_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    packed = centroids(df, vector).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "c"))).alias("p"))
    return packed.select("label", F.transform("p", lambda x: x["c"]).alias("centroid"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def to_centroid(df: DataFrame) -> DataFrame:
    """df's members with sim, the cosine with their own cluster's centroid."""
    members = df.where("label <> -1").withColumn("__u", unit())
    return members.join(F.broadcast(centroid_vectors(df)), "label").withColumn("sim", _dot("__u", "centroid")).drop("__u", "centroid")


def representatives(df: DataFrame, n: int = 3) -> DataFrame:
    """(label, idx, sim, rank): the n members nearest to their centroid; of equal ones the higher idx first."""
    ranked = to_centroid(df).select("label", "idx", F.round("sim", 12).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("sim"), F.desc("idx")))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= n)


def spread(df: DataFrame) -> DataFrame:
    """(label, size, spread): population deviation of the cosine distance to the centroid, 0 to 1."""
    return to_centroid(df).groupBy("label").agg(F.count("*").alias("size"), F.least(F.greatest(F.stddev_pop(1 - F.col("sim")), F.lit(0.0)), F.lit(1.0)).alias("spread"))


def coherence(df: DataFrame) -> DataFrame:
    """(label, size, coherence): mean pairwise cosine within each cluster, from the sum of unit vectors instead of the pairs; 1 for a single member."""
    rows = df.where("label <> -1").select("label", "idx", unit().alias("u"))
    size = rows.groupBy("label").agg(F.count("*").alias("size"), F.sum(_dot("u", "u")).alias("own"))
    total = rows.select("label", F.posexplode("u").alias("k", "x")).groupBy("label", "k").agg(F.sum("x").alias("s")).groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    mean = (F.col("all") - F.col("own")) / (F.col("size") * (F.col("size") - 1))
    return size.join(F.broadcast(total), "label").select("label", "size", F.when(F.col("size") < 2, 1.0).otherwise(mean).alias("coherence"))


def distance_sums(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(idx, label, other, total, n): Euclidean distances of each point of df(idx, label, vector) to each cluster, itself included as 0. One pass over the grid serves every silhouette of merged or split labels."""

    def sums(t: pd.DataFrame) -> pd.DataFrame:
        ba, bb = t["ba"].iloc[0], t["bb"].iloc[0]
        a, b = t[t["own"] == ba], t[t["own"] == bb]
        out = [pd.DataFrame({"idx": [], "label": [], "other": [], "total": [], "n": []}).astype({"idx": "int64", "label": "int64", "other": "int64", "total": "float64", "n": "int64"})]
        for x, y in ((a, b), (b, a))[: 1 if ba == bb else 2]:
            if not len(x) or not len(y):
                continue
            p, q = np.stack(x["v"].to_numpy()).astype(float), np.stack(y["v"].to_numpy()).astype(float)
            square = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T
            d = np.sqrt(np.maximum(square, 0))
            d[x["idx"].to_numpy()[:, None] == y["idx"].to_numpy()[None, :]] = 0
            names, at = np.unique(y["label"].to_numpy(), return_inverse=True)
            one = np.zeros((len(y), len(names)))
            one[np.arange(len(y)), at] = 1
            out.append(pd.DataFrame({"idx": np.repeat(x["idx"].to_numpy(), len(names)), "label": np.repeat(x["label"].to_numpy(), len(names)), "other": np.tile(names, len(x)), "total": (d @ one).ravel(), "n": np.tile(one.sum(0).astype("int64"), len(x))}))
        return pd.concat(out)

    rows = df.select("idx", "label", F.col(vector).alias("v"))
    return _grid(rows, ["idx", "label", "v"]).groupBy("ba", "bb").applyInPandas(sums, "idx long, label long, other long, total double, n long").groupBy("idx", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette_samples(sums: DataFrame) -> DataFrame:
    """(idx, label, s) from distance sums; a point alone in its cluster has 0."""
    own, other = F.col("label") == F.col("other"), F.col("label") != F.col("other")
    per = sums.groupBy("idx", "label").agg(
        F.max(F.when(own & (F.col("n") > 1), F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("n"), F.min(F.when(other, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("n") < 2, 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.select("idx", "label", s.alias("s"))


def silhouette(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: the mean silhouette of points that are not noise; null with fewer than two clusters."""
    return silhouette_samples(distance_sums(df.where("label <> -1"), vector)).agg(F.avg("s").alias("silhouette"))


def centroid_pairs(df: DataFrame) -> DataFrame:
    """(a, b, sim) of every two clusters, a < b; as many rows as clusters squared, which are few."""
    c = centroids(df)
    left, right = c.select(F.col("label").alias("a"), "k", F.col("c").alias("x")), c.select(F.col("label").alias("b"), "k", F.col("c").alias("y"))
    return left.join(right, "k").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))


def uncertainty_queue(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most uncertain rows of df(idx, label, prob): 1 for noise, else 1 - prob."""
    u = F.when(F.col("label") == -1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce("prob", F.lit(1.0))))
    rows = df.select("idx", "label", F.bround(u, 4).alias("uncertainty"), (F.col("label") == -1).alias("is_noise"))
    return rows.orderBy(F.desc("uncertainty"), F.desc("is_noise"), "idx").limit(k)


def cluster_quality(df: DataFrame) -> DataFrame:
    """n_clusters, noise_count, noise_rate (4 digits)."""
    noise = F.count_if(F.col("label") == -1)
    return df.agg(F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"), noise.alias("noise_count"), F.round(F.try_divide(noise, F.count("*")), 4).alias("noise_rate"))
