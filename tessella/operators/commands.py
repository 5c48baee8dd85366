"""State changes of a session, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def submit_feedback(requirements: DataFrame, clusters: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requirements and clusters after moves(requirement_id, new_cluster_id); of several moves of a row the last by id counts. Sizes follow; flags and probabilities do not; noise has no size."""
    last = moves.withColumn("n", F.row_number().over(Window.partitionBy("requirement_id").orderBy(F.desc("id")))).where("n = 1").select(F.col("requirement_id").alias("id"), "new_cluster_id")
    moved = requirements.join(last, "id", "left").withColumn("__new", F.coalesce("new_cluster_id", "cluster_id"))
    changed = moved.where("__new <> cluster_id OR (cluster_id IS NULL AND __new IS NOT NULL)")
    delta = changed.select(F.explode(F.array(F.struct(F.col("cluster_id").alias("c"), F.lit(-1).alias("d")), F.struct(F.col("__new").alias("c"), F.lit(1).alias("d")))).alias("x")).groupBy(F.col("x.c").alias("cluster_id")).agg(F.sum("x.d").alias("__d"))
    sizes = clusters.join(F.broadcast(delta), "cluster_id", "left").withColumn("size", (F.col("size") + F.coalesce("__d", F.lit(0))).cast("int")).select(clusters.columns)
    return moved.withColumn("cluster_id", F.col("__new")).select(requirements.columns), sizes


def review_feedback(requirements: DataFrame, clusters: DataFrame, corrections: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rejection of pending corrections (rejected: their ids) puts rows back where they came from; returns the three tables. A correction that is not pending stays."""
    hit = corrections.join(rejected.select("id").distinct(), "id", "left_semi").where("status = 'pending'")
    back = hit.select("id", "requirement_id", F.col("previous_cluster_id").alias("new_cluster_id"))
    rows, sizes = submit_feedback(requirements, clusters, back)
    status = F.when(F.col("__hit"), "rejected").otherwise(F.col("status"))
    new = corrections.join(hit.select("id", F.lit(True).alias("__hit")), "id", "left").withColumn("status", status).select(corrections.columns)
    return rows, sizes, new


def apply_merge(requirements: DataFrame, clusters: DataFrame, a: int, b: int) -> tuple[DataFrame, DataFrame]:
    """b's rows join a; a's size grows by b's and b is emptied."""
    rows = requirements.withColumn("cluster_id", F.when(F.col("cluster_id") == b, a).otherwise(F.col("cluster_id")))
    added = clusters.where(F.col("cluster_id") == b).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("__n"))
    size = F.when(F.col("cluster_id") == a, F.col("size") + F.col("__n")).otherwise(F.col("size")).cast("int")
    return rows, clusters.where(F.col("cluster_id") != b).join(F.broadcast(added)).withColumn("size", size).select(clusters.columns)


def apply_split(requirements: DataFrame, clusters: DataFrame, cluster: int, sub_labels: list[int]) -> tuple[DataFrame, DataFrame]:
    """Members whose sub-label (by place in id order) is 1 get the next free cluster. A changed number of members is an error."""
    members = requirements.where(F.col("cluster_id") == cluster)
    if members.count() != len(sub_labels):
        raise ValueError("the cluster has changed since the suggestion was made")
    new = (clusters.agg(F.coalesce(F.max("cluster_id"), F.lit(-1))).first()[0]) + 1
    k = F.row_number().over(Window.orderBy("id")) - 1
    second = members.select("id", F.get(F.lit(sub_labels), k).alias("__s")).where("__s = 1").select("id", F.lit(new).alias("__new"))
    rows = requirements.join(F.broadcast(second), "id", "left").withColumn("cluster_id", F.coalesce("__new", "cluster_id")).select(requirements.columns)
    ones = sum(sub_labels)
    old = clusters.withColumn("size", F.when(F.col("cluster_id") == cluster, F.col("size") - ones).otherwise(F.col("size")).cast("int"))
    made = clusters.where(F.col("cluster_id") == cluster).withColumns({"cluster_id": F.lit(new), "size": F.lit(ones), "label": F.concat("label", F.lit(" (2)"))})
    return rows, old.unionByName(made.select(old.columns))


def snapshot(requirements: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row, state: the JSON that the audit log keeps before and after a change."""
    c = clusters.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "label", "size"))).alias("clusters"))
    r = requirements.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string").alias("k"), F.coalesce("cluster_id", F.lit(-1)).alias("v"))))).alias("requirement_assignments"))
    return c.join(r).select(F.to_json(F.struct("clusters", "requirement_assignments")).alias("state"))


def decide(suggestions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suggestions after decisions(id, action accept/reject), and the decisions that were refused: unknown ids and suggestions no longer pending."""
    known = decisions.join(suggestions.select("id", "status"), "id", "left")
    ok = F.coalesce(F.col("status") == "pending", F.lit(False)) & F.col("action").isin("accept", "reject")
    good = known.where(ok).select("id", F.when(F.col("action") == "accept", "applied").otherwise("rejected").alias("__s"))
    return suggestions.join(F.broadcast(good), "id", "left").withColumn("status", F.coalesce("__s", "status")).select(suggestions.columns), known.where(~ok).select("id", "action", F.coalesce("status", F.lit("unknown")).alias("status"))


def next_iteration(iterations: DataFrame, session_id: int) -> DataFrame:
    return iterations.where(F.col("session_id") == session_id).agg((F.coalesce(F.max("iteration"), F.lit(0)) + 1).alias("iteration"))


def enrichment_status(requirements: DataFrame, enriched: DataFrame) -> DataFrame:
    """total, succeeded, failed, pending, status from each requirement's latest row."""
    w = Window.partitionBy("requirement_id").orderBy(F.desc("updated_at"), F.desc("id"))
    newest = enriched.withColumn("n", F.row_number().over(w)).where("n = 1").select("requirement_id", F.col("status").alias("s"))
    j = requirements.select("id").join(newest, F.col("id") == F.col("requirement_id"), "left")
    t = j.agg(F.count("*").alias("total"), F.count_if(F.col("s") == "succeeded").alias("succeeded"), F.count_if(F.col("s") == "failed").alias("failed"))
    t = t.withColumn("pending", F.col("total") - F.col("succeeded") - F.col("failed"))
    status = F.when(F.col("succeeded") + F.col("failed") == 0, "not_started").when(F.col("succeeded") == F.col("total"), "complete").when(F.col("succeeded") == 0, "failed").otherwise("partial")
    return t.withColumn("status", status)


def complete_group(requirements: DataFrame, enriched: DataFrame) -> DataFrame:
    """The newest (provider, model, prompt_version) whose successes cover every requirement; no row if none does."""
    n = requirements.agg(F.count("*").alias("n"))
    groups = enriched.where("status = 'succeeded'").join(requirements.select(F.col("id").alias("requirement_id")), "requirement_id", "left_semi").groupBy("provider", "model", "prompt_version").agg(F.count_distinct("requirement_id").alias("k"), F.max("updated_at").alias("newest"))
    return groups.join(F.broadcast(n)).where("k = n").orderBy(F.desc("newest"), "provider", "model", "prompt_version").limit(1).select("provider", "model", "prompt_version")


def reset_stale(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("status", F.when(F.col("status") == "processing", "error").otherwise(F.col("status")))
