"""Exports: delimited text, a JSON bundle, and two interchange XML formats."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import RELATION_KEYWORDS
from ..lineage import folder
from ..operators.ingest import number_rows


def xml(value: Column) -> Column:
    """Escaped for XML text and attributes; line ends and tabs as references, so that a fragment is one line."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def csv_rows(requirements: DataFrame, clusters: DataFrame) -> DataFrame:
    """id, text, module, section, cluster_id, cluster_label, membership_prob: label Noise for -1, empty for none, 'Cluster n' where its row is missing."""
    names = clusters.select("cluster_id", F.col("label").alias("__l"))
    label = F.when(F.col("cluster_id").isNull(), "").when(F.col("cluster_id") == -1, "Noise").otherwise(F.coalesce("__l", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))))
    return requirements.join(names, "cluster_id", "left").select(F.col("req_id").alias("id"), "text", "module", "section", "cluster_id", label.alias("cluster_label"), "membership_prob")


#: Where a fragment stands in its document.
_PLACE = ["o", "k", "j", "i"]


def _fragment(df: DataFrame, o, k, j, i, x: Column) -> DataFrame:
    long = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return df.select(long(o).alias("o"), long(k).alias("k"), long(j).alias("j"), long(i).alias("i"), x.alias("x"))


def _once(spark: SparkSession, o: int, text: str) -> DataFrame:
    return _fragment(spark.range(1), o, 0, 0, 0, F.lit(text))


def fragments_in_order(fragments: DataFrame) -> DataFrame:
    """(n, x): a document's fragments, numbered from 1."""
    return number_rows(fragments.withColumn("__o", F.struct(*_PLACE)), "__o", "n").select((F.col("n") + 1).alias("n"), "x")


def write_document(fragments: DataFrame, path: str) -> None:
    """Fragments as one file, a line each.

    They are sorted by range and written as parts, each by a task of its own;
    the parts then become one file: by the file system alone where it can
    join files, else part after part through a buffer. No task and no
    variable holds the document.
    """
    spark = fragments.sparkSession
    parts = f"{path}.parts"
    fragments.orderBy(*_PLACE).select("x").write.mode("overwrite").text(parts)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    files = sorted((f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts)) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    if fs.exists(target):
        fs.delete(target, False)
    first, rest = files[0], files[1:]
    joined = False
    if rest and hasattr(fs, "concat") and fs.getScheme() == "hdfs":
        array = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(rest))
        for n, f in enumerate(rest):
            array[n] = f
        fs.concat(first, array)
        joined = fs.rename(first, target)
    if not joined:
        out = fs.create(target, True)
        for f in files:
            stream = fs.open(f)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(parts), True)


def document(fragments: DataFrame) -> DataFrame:
    """One row, document: the file that write_document() makes, for readers that want it whole."""
    path = folder(fragments.sparkSession, "document")
    write_document(fragments, path)
    return fragments.sparkSession.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def _listed(df: DataFrame, o: int, k, i, j: Column) -> DataFrame:
    """JSON values of a list, each but the first after a comma."""
    rows = _fragment(df, o, k, 0, i, j)
    first = rows.agg(F.min(F.struct(*_PLACE)).alias("__first"))  # one row
    return rows.join(F.broadcast(first)).withColumn("x", F.when(F.struct(*_PLACE) == F.col("__first"), F.col("x")).otherwise(F.concat(F.lit(","), "x"))).drop("__first")


def bundle_fragments(session_name: str, requirements: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """The fragments of a JSON document: items (clusters, then requirements), relationships, and their counts. edges: (source_id, target_id, relation, weight)."""
    spark = requirements.sparkSession
    items = clusters.select(F.lit(0).alias("a"), F.col("cluster_id").cast("long").alias("b"), F.to_json(F.struct(F.lit("cluster").alias("type"), F.col("cluster_id").alias("id"), F.col("label").alias("name"), "size")).alias("y")).unionByName(
        requirements.select(F.lit(1).alias("a"), F.col("id").alias("b"), F.to_json(F.struct(F.lit("requirement").alias("type"), "id", F.col("req_id").alias("name"), "text", "cluster_id")).alias("y")))
    related = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.to_json(F.struct(F.col("source_id").alias("from"), F.col("target_id").alias("to"), F.col("relation").alias("type"), "weight")).alias("y"))
    head = f'{{"meta":{{"session":{json.dumps(session_name, ensure_ascii=False)},"items":{items.count()},"relationships":{related.count()}}},"items":['
    return _once(spark, 0, head).unionByName(_listed(items, 1, F.col("a"), F.col("b"), F.col("y"))).unionByName(_once(spark, 2, '],"relationships":[')).unionByName(_listed(related, 3, F.col("a"), F.col("b"), F.col("y"))).unionByName(_once(spark, 4, "]}"))


def bundle(session_name: str, requirements: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """bundle_fragments() as one row."""
    return document(bundle_fragments(session_name, requirements, clusters, edges))


def _quoted(name: str) -> str:
    return name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def reqif_fragments(name: str, requirements: DataFrame, clusters: DataFrame, timestamp: str) -> DataFrame:
    """The fragments of a ReqIF 1.2 document: cluster headings and requirements as objects, then a hierarchy of clusters with their requirements, noise after them, rows without a cluster last."""
    spark = requirements.sparkSession

    def obj(ident: Column, kind: str, attrs: list[tuple[str, Column]]) -> Column:
        values = F.concat(*[F.concat(F.lit('<ATTRIBUTE-VALUE-STRING THE-VALUE="'), xml(v), F.lit(f'"><DEFINITION><ATTRIBUTE-DEFINITION-STRING-REF>{n}</ATTRIBUTE-DEFINITION-STRING-REF></DEFINITION></ATTRIBUTE-VALUE-STRING>')) for n, v in attrs])
        return F.concat(F.lit('<SPEC-OBJECT IDENTIFIER="'), ident, F.lit('"><VALUES>'), values, F.lit(f"</VALUES><TYPE><SPEC-OBJECT-TYPE-REF>{kind}</SPEC-OBJECT-TYPE-REF></TYPE></SPEC-OBJECT>"))

    def node(ident: Column, end: str) -> Column:
        return F.concat(F.lit('<SPEC-HIERARCHY IDENTIFIER="SH-'), ident, F.lit('"><OBJECT><SPEC-OBJECT-REF>'), ident, F.lit(f"</SPEC-OBJECT-REF></OBJECT>{end}"))

    heading, leaf = F.concat(F.lit("CL-"), _text("cluster_id")), F.concat(F.lit("RQ-"), _text("id"))
    types = "".join(f'<SPEC-OBJECT-TYPE IDENTIFIER="{t}"><SPEC-ATTRIBUTES>{"".join(f"<ATTRIBUTE-DEFINITION-STRING IDENTIFIER={chr(34)}{a}{chr(34)}><TYPE><DATATYPE-DEFINITION-STRING-REF>dt-string</DATATYPE-DEFINITION-STRING-REF></TYPE></ATTRIBUTE-DEFINITION-STRING>" for a in attrs)}</SPEC-ATTRIBUTES></SPEC-OBJECT-TYPE>' for t, attrs in (("type-heading", ["attr-name"]), ("type-requirement", ["attr-id", "attr-text"])))
    head = f'<?xml version="1.0" encoding="UTF-8"?><REQ-IF xmlns="http://www.omg.org/spec/ReqIF/20110401/reqif.xsd"><THE-HEADER><REQ-IF-HEADER IDENTIFIER="header-1"><CREATION-TIME>{timestamp}</CREATION-TIME><REQ-IF-VERSION>1.2</REQ-IF-VERSION><TITLE>{_quoted(name)}</TITLE></REQ-IF-HEADER></THE-HEADER><CORE-CONTENT><REQ-IF-CONTENT><DATATYPES><DATATYPE-DEFINITION-STRING IDENTIFIER="dt-string" MAX-LENGTH="65535"/></DATATYPES><SPEC-TYPES>{types}<SPECIFICATION-TYPE IDENTIFIER="type-spec"/></SPEC-TYPES><SPEC-OBJECTS>'
    tail = "</CHILDREN><TYPE><SPECIFICATION-TYPE-REF>type-spec</SPECIFICATION-TYPE-REF></TYPE></SPECIFICATION></SPECIFICATIONS></REQ-IF-CONTENT></CORE-CONTENT></REQ-IF>"
    known = clusters.select("cluster_id").distinct()
    parts = [
        _once(spark, 0, head),
        _fragment(clusters, 1, 0, 0, F.col("cluster_id"), obj(heading, "type-heading", [("attr-name", F.col("label"))])),
        _fragment(requirements, 1, 1, 0, F.col("id"), obj(leaf, "type-requirement", [("attr-id", F.col("req_id")), ("attr-text", F.col("text"))])),
        _once(spark, 2, '</SPEC-OBJECTS><SPECIFICATIONS><SPECIFICATION IDENTIFIER="SPEC-1"><CHILDREN>'),
        _fragment(clusters, 3, F.col("cluster_id"), 0, 0, node(heading, "<CHILDREN>")),
        _fragment(requirements.where("cluster_id >= 0").join(known, "cluster_id", "left_semi"), 3, F.col("cluster_id"), 1, F.col("id"), node(leaf, "</SPEC-HIERARCHY>")),
        _fragment(clusters, 3, F.col("cluster_id"), 2, 0, F.lit("</CHILDREN></SPEC-HIERARCHY>")),
        _fragment(requirements.where("cluster_id IS NULL OR cluster_id < 0"), F.when(F.col("cluster_id").isNull(), 5).otherwise(4), 0, 0, F.col("id"), node(leaf, "</SPEC-HIERARCHY>")),
        _once(spark, 6, tail),
    ]
    return reduce(DataFrame.unionByName, parts)


def reqif(name: str, requirements: DataFrame, clusters: DataFrame, timestamp: str) -> DataFrame:
    """reqif_fragments() as one row."""
    return document(reqif_fragments(name, requirements, clusters, timestamp))


def xmi_fragments(name: str, requirements: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """The fragments of an XMI 2.5.1 document: a package per cluster that has rows (noise and rows without one in another, the last), a class with a comment per requirement, a dependency per edge."""
    spark = requirements.sparkSession
    keyword = F.coalesce(*[F.when(F.col("relation") == r, k) for r, k in RELATION_KEYWORDS.items()], F.lit("trace"))
    cls = F.concat(F.lit('<packagedElement xmi:type="uml:Class" xmi:id="R'), _text("id"), F.lit('" name="'), xml(F.col("req_id")), F.lit('"><ownedComment body="'), xml(F.col("text")), F.lit('"/></packagedElement>'))
    label = F.when(F.col("cluster_id") == -1, "Noise").otherwise(F.coalesce("label", F.concat(F.lit("Cluster "), _text("cluster_id"))))
    rows = requirements.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    packages = rows.select("cluster_id").distinct().join(clusters.select("cluster_id", "label"), "cluster_id", "left")
    at = F.when(F.col("cluster_id") == -1, 2).otherwise(1)
    link = F.concat(F.lit('<packagedElement xmi:type="uml:Dependency" xmi:id="D'), _text("source_id"), F.lit("-"), _text("target_id"), F.lit('" name="'), keyword, F.lit('" supplier="R'), _text("source_id"), F.lit('" client="R'), _text("target_id"), F.lit('"/>'))
    parts = [
        _once(spark, 0, f'<?xml version="1.0" encoding="UTF-8"?><xmi:XMI xmlns:xmi="http://www.omg.org/spec/XMI/20131001" xmlns:uml="http://www.omg.org/spec/UML/20161101"><uml:Model xmi:id="M1" name="{_quoted(name)}">'),
        _fragment(packages, at, F.col("cluster_id"), 0, 0, F.concat(F.lit('<packagedElement xmi:type="uml:Package" xmi:id="P'), _text("cluster_id"), F.lit('" name="'), xml(label), F.lit('">'))),
        _fragment(rows, at, F.col("cluster_id"), 1, F.col("id"), cls),
        _fragment(packages, at, F.col("cluster_id"), 2, 0, F.lit("</packagedElement>")),
        _fragment(edges, 3, F.col("source_id"), 0, F.col("target_id"), link),
        _once(spark, 4, "</uml:Model></xmi:XMI>"),
    ]
    return reduce(DataFrame.unionByName, parts)


def xmi(name: str, requirements: DataFrame, clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """xmi_fragments() as one row."""
    return document(xmi_fragments(name, requirements, clusters, edges))


def feedback_rows(corrections: DataFrame) -> DataFrame:
    """The nine columns of the feedback export, newest first."""
    return corrections.orderBy(F.desc("created_at"), F.desc("id")).select("id", "requirement_id", "previous_cluster_id", "new_cluster_id", "confidence_score", "comments", "applied_by", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


#: Of each format: media type and file ending.
FORMATS = {"reqif": ("application/xml", "reqif"), "sysml": ("application/xml", "xmi"), "jama": ("application/json", "json"), "csv": ("text/csv", "csv")}


def export_session(kind: str, session_id: int, name: str, requirements: DataFrame, clusters: DataFrame, edges: DataFrame, timestamp: str) -> tuple[DataFrame, str, str]:
    """A session in one of the formats, its media type and file name. edges hold ids (edges_by_id); csv gives rows, the others one document. An unknown format is a ValueError."""
    kind = (kind or "").strip().lower()
    if kind not in FORMATS:
        raise ValueError(f"unsupported format {kind!r}; use one of {', '.join(sorted(FORMATS))}")
    made = {"reqif": lambda: reqif(name, requirements, clusters, timestamp), "sysml": lambda: xmi(name, requirements, clusters, edges), "jama": lambda: bundle(name, requirements, clusters, edges), "csv": lambda: csv_rows(requirements, clusters)}
    media, ending = FORMATS[kind]
    return made[kind](), media, f"session_{session_id}.{ending}"
