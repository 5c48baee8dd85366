"""Stored tables of a session: schemas, partition overwrite, upsert and append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "sessions": "id long, name string, filename string, created_at timestamp_ntz, status string, total_requirements int, total_clusters int, noise_count int",
    "requirements": "id long, session_id long, req_id string, text string, module string, section string, cluster_id int, membership_prob double, umap_x double, umap_y double, is_noise boolean",
    "clusters": "id long, session_id long, cluster_id int, label string, keywords array<string>, size int",
    "graphs": "id long, session_id long, nodes array<struct<id:int,node_id:string,requirement_text:string,cluster_id:int,x:double,y:double,is_noise:boolean>>, edges array<struct<source:int,target:int,weight:double>>",
    "dependency_trees": "id long, session_id long, nodes array<struct<id:int,node_id:string,requirement_text:string,cluster_id:int,level:int>>, edges array<struct<source:int,target:int,relation:string,weight:double>>, stats struct<n_nodes:int,n_edges:int,max_depth:int,root_count:int,relation_counts:map<string,int>>, rationale string, provider string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "enriched_requirements": "id long, session_id long, requirement_db_id long, requirement_id string, requirement_text_hash string, provider string, model string, prompt_version string, embedding_mode_recommended string, expanded_text string, domain_terms array<string>, mentioned_components array<string>, assumptions array<string>, warnings array<string>, functional_intent string, confidence double, quality_report string, status string, error_message string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "refinement_suggestions": "id long, session_id long, type string, status string, cluster_a_id int, cluster_b_id int, cluster_id int, similarity double, silhouette_before double, silhouette_after double, silhouette_delta double, coherence double, rationale string, summary string, labels string, keywords array<string>, sub_labels array<int>, sub_sizes array<int>, created_at timestamp_ntz, updated_at timestamp_ntz",
    "session_edges": "session_id long, source int, target int, weight double",
    "dependency_nodes": "session_id long, requirement_id long, node_id string, cluster_id int, level int",
    "dependency_edges": "session_id long, source_id long, target_id long, relation string, weight double",
    "suggestion_sides": "session_id long, suggestion_id long, requirement_id long, side int",
    "refinement_audit_log": "id long, session_id long, suggestion_id long, action string, before_state string, after_state string, applied_by string, created_at timestamp_ntz",
    "feedback_corrections": "id long, session_id long, requirement_id long, previous_cluster_id int, new_cluster_id int, confidence_score double, comments string, applied_by string, status string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "clustering_iterations": "id long, session_id long, iteration int, n_clusters int, noise_count int, noise_rate double, silhouette double, must_link_pairs int, cannot_link_pairs int, points_moved int, created_at timestamp_ntz",
    "constraint_pairs": "id long, session_id long, requirement_a_id long, requirement_b_id long, constraint_type string, feedback_id long, created_at timestamp_ntz",
}
ENRICHMENT_KEY = ["session_id", "requirement_db_id", "requirement_text_hash", "provider", "model", "prompt_version"]


class Store:
    """Parquet tables under one root, partitioned by session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def read(self, table: str, session_id: int | None = None) -> DataFrame:
        """A table, pruned to a session's partition; empty where nothing was written yet."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(table))
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
        return df if session_id is None else df.where(F.col("session_id" if table != "sessions" else "id") == session_id)

    def _write(self, table: str, df: DataFrame, mode: str) -> None:
        typed = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMAS[table]).schema])
        w = typed.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        (w if table == "sessions" else w.partitionBy("session_id")).parquet(self.path(table))

    def append(self, table: str, df: DataFrame) -> None:
        self._write(table, df, "append")

    def replace(self, table: str, df: DataFrame) -> None:
        """Overwrite the partitions of the sessions in df. df is written aside first where it reads the same table."""
        aside = self.path(f"_{table}.new")
        df.write.mode("overwrite").parquet(aside)
        self._write(table, self.spark.read.parquet(aside), "overwrite")

    def upsert(self, table: str, rows: DataFrame, key: list[str]) -> None:
        """Rows replace those of equal key in their sessions; the others stay."""
        sessions = F.broadcast(rows.select("session_id").distinct())
        old = self.read(table).join(sessions, "session_id", "left_semi").join(rows.select(*key).distinct(), key, "left_anti")
        self.replace(table, old.select(rows.columns).unionByName(rows))


def cache_misses(rows: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(cached.select(*key), key, "left_anti")


def text_hash(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
