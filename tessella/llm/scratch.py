"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Parquet tables under the session's spark.checkpoint.dir.

    Writing a table cuts the lineage: a lost executor costs the tasks it was
    running, never the stages before the table. Only where the setting is
    missing (tests) does a folder of this machine serve instead.
    """

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.gettempdir() + "/tessella"
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return the table just written."""
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later step reads; with none, only the shuffle files of what has been written."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                if path.startswith("file:///"):
                    path = "file:" + path[7:]
                p = jvm.org.apache.hadoop.fs.Path(path)
                if self.root.split("/")[-1] in path:
                    p.getFileSystem(conf).delete(p, True)
        # Spark deletes the shuffle files of plans that the driver's collector has found dead
        jvm.System.gc()


def one_per_id(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs(doc_id, text) with one row per doc_id (the least text), and whether any doc_id was there twice. Only ids are shuffled to find that out."""
    twice = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return (docs.groupBy("doc_id").agg(F.min("text").alias("text")), True) if twice else (docs, False)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
