"""Reading a session: loaders, lists, views with filters, and joins for display."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_text
from ..functions.words import CONFLICT_MESSAGE
from .ingest import number_rows


def load_session(sessions: DataFrame, session_id: int, status: str | None = None) -> DataFrame:
    """The one row of a session; none is a LookupError, another status than the one asked for a ValueError."""
    row = sessions.where(F.col("id") == session_id)
    found = row.select("status").first()
    if found is None:
        raise LookupError(f"no session {session_id}")
    if status is not None and found["status"] != status:
        raise ValueError(f"session {session_id} is {found['status']}, not {status}")
    return row


def newest_first(rows: DataFrame, session_id: int | None = None, status: str | None = None, at: str = "created_at") -> DataFrame:
    """Rows of a session, of one status if given, newest first; equal times by the higher id. Lists of sessions, suggestions, audit rows and the feedback queue are all this."""
    if session_id is not None:
        rows = rows.where(F.col("session_id") == session_id)
    if status:
        rows = rows.where(F.col("status") == status)
    return rows.orderBy(F.desc(at), F.desc("id"))


def clusters_by_size(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("size"), "cluster_id")


def cluster_detail(clusters: DataFrame, requirements: DataFrame, cluster_id: int) -> DataFrame:
    """A cluster's columns (prefix cluster_) beside each of its requirements; an unknown cluster is a LookupError, one without members a row of nulls."""
    own = clusters.where(F.col("cluster_id") == cluster_id)
    if own.isEmpty():
        raise LookupError(f"no cluster {cluster_id}")
    named = own.select("cluster_id", F.col("label").alias("cluster_label"), F.col("size").alias("cluster_size"))
    return named.join(requirements.where(F.col("cluster_id") == cluster_id), "cluster_id", "left")


def shown(requirements: DataFrame, cluster: int | None = None, noise: str = "all") -> DataFrame:
    """Requirements of one cluster, and all of them, only noise or only clustered ones."""
    if noise not in ("all", "noise", "clustered"):
        raise ValueError(f"unknown choice {noise!r}")
    if cluster is not None:
        requirements = requirements.where(F.col("cluster_id") == cluster)
    is_noise = F.coalesce("is_noise", F.lit(False))
    return requirements if noise == "all" else requirements.where(is_noise if noise == "noise" else ~is_noise)


def with_last(requirements: DataFrame, rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """requirements with columns of their last row by order, null where there is none. The last one is an aggregate, so a requirement with very many rows makes no large group."""
    last = rows.groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("__l"))
    return requirements.join(last, F.col("id") == F.col("__k"), "left").select(*requirements.columns, *[F.col(f"__l.{c}").alias(c) for c in columns])


def enrichment_view(results: DataFrame, requirements: DataFrame, search: str = "", status: str | None = None, unsure: bool = False, warned: bool = False) -> DataFrame:
    """Results whose requirement id, expanded text or requirement's text hold the search, of one status, under 0.7 sure (none given counts as sure), with warnings; as far as asked. A result meets the one requirement whose id is its requirement_db_id: req_ids may repeat."""
    text = requirements.select(F.col("id").alias("requirement_db_id"), F.col("text").alias("__text"))
    rows = results.join(text, "requirement_db_id", "left")
    wanted = search.strip().lower()
    if wanted:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("requirement_id", "expanded_text", "__text")])), F.lit(wanted)))
    if status:
        rows = rows.where(F.col("status") == status)
    if unsure:
        rows = rows.where("coalesce(confidence, 1) < 0.7")
    if warned:
        rows = rows.where("size(warnings) > 0")
    return rows.select(*results.columns)


def displayed_terms(results: DataFrame, order: str) -> DataFrame:
    """(term, first): the terms of all results without regard to case, each spelt as where it comes first."""
    each = results.select(F.col(order).alias("o"), F.posexplode("domain_terms").alias("p", "term"))
    first = each.groupBy(F.lower("term").alias("__k")).agg(F.min(F.struct("o", "p", "term")).alias("f"))
    return first.select(F.col("f.term").alias("term"), F.struct("f.o", "f.p").alias("first"))


def edges_with_nodes(edges: DataFrame, nodes: DataFrame, least: float | None = None, relation: str | None = None) -> DataFrame:
    """Edges of a weight of at least least and of one relation, with both ends' nodes(id, x, y); an edge whose end is missing is left out."""
    if least is not None:
        edges = edges.where(F.col("weight") >= least)
    if relation is not None:
        edges = edges.where(F.col("relation") == relation)
    ends = {s: nodes.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in nodes.columns if c != "id"]) for s in ("source", "target")}
    return edges.join(ends["source"], "source").join(ends["target"], "target")


def grouped(nodes: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, members): one row per cluster or level with its members in the order of id. For display: a row holds its whole group."""
    return nodes.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("id", *columns))).alias("members"))


def layered(nodes: DataFrame, level: str = "level") -> DataFrame:
    """nodes with x, the level, and y: members of a level in the order of id, one apart and centred on 0."""
    w = Window.partitionBy(level)
    place = F.row_number().over(w.orderBy("id")) - 1
    return nodes.withColumns({"x": F.col(level).cast("double"), "y": place - (F.count("*").over(w) - 1) / 2})


def summary_texts(representatives: DataFrame, texts: DataFrame) -> DataFrame:
    """(label, summary): the texts of representatives(label, idx, rank) in the order of rank, trimmed, blank ones left out, joined by semicolons."""
    said = representatives.join(texts.select("idx", F.trim("text").alias("t")), "idx")
    listed = said.groupBy("label").agg(F.sort_array(F.collect_list(F.when(F.col("t") != "", F.struct("rank", "t")))).alias("l"))
    return listed.select("label", F.array_join(F.transform("l", lambda x: x["t"]), "; ").alias("summary"))


def _json_ok(column: Column, kind: str) -> Column:
    """Null, or JSON of the kind."""
    found = F.json_array_length(column) if kind == "list" else F.json_object_keys(column)
    return column.isNull() | found.isNotNull()


def plain_hash(text: str = "text") -> Column:
    """The hash under which a requirement's expansion is stored: of its plain text, 12,000 characters at most."""
    return F.sha2(plain_text(text, 12_000), 256)


def valid_enrichments(rows: DataFrame, requirements: DataFrame, prompt_version: str, provider: str | None = None, model: str | None = None, lists: tuple[str, ...] = (), objects: tuple[str, ...] = ()) -> DataFrame:
    """Rows that can serve again: succeeded, for the requirement's present text and this prompt, with a text that is not blank, the columns named lists and objects null or such JSON; of one provider and model if given."""
    now = requirements.select(F.col("id").alias("requirement_db_id"), plain_hash("text").alias("__h"))
    ok = (F.col("status") == "succeeded") & (F.col("prompt_version") == prompt_version) & (F.col("requirement_text_hash") == F.col("__h")) & (plain_text("expanded_text") != "")
    for name, value in (("provider", provider), ("model", model)):
        if value is not None:
            ok = ok & (F.col(name) == value)
    for columns, kind in ((lists, "list"), (objects, "object")):
        for c in columns:
            ok = ok & _json_ok(F.col(c), kind)
    return rows.join(now, "requirement_db_id").where(ok).drop("__h")


def named_conflicts(conflicts: DataFrame, requirements: DataFrame) -> DataFrame:
    """Conflicts (a, b) with both requirements' labels and texts and a message; a missing requirement is called REQ-id in its label, by its id alone in the message, and has an empty text."""
    out = conflicts
    for s in ("a", "b"):
        out = out.join(requirements.select(F.col("id").alias(s), F.col("req_id").alias(f"__{s}"), F.col("text").alias(f"__{s}_text")), s, "left")
    ident = {s: F.col(s).cast("string") for s in ("a", "b")}
    message = F.format_string(CONFLICT_MESSAGE, *[F.coalesce(F.col(f"__{s}"), ident[s]) for s in ("a", "b")])
    named = {f"{s}_label": F.coalesce(F.col(f"__{s}"), F.concat(F.lit("REQ-"), ident[s])) for s in ("a", "b")}
    texts = {f"{s}_text": F.coalesce(F.col(f"__{s}_text"), F.lit("")) for s in ("a", "b")}
    return out.withColumns({**named, **texts, "message": message}).select("a", "b", *named, *texts, "message")


def edges_by_id(edges: DataFrame, requirements: DataFrame) -> DataFrame:
    """Dependency edges between row numbers as edges between ids, with both req_ids: rows are numbered in the order of id. An end without a row is null."""
    rows = number_rows(requirements.select("id", "req_id"), "id")
    out = edges
    for s in ("source", "target"):
        out = out.join(rows.select(F.col("idx").alias(s), F.col("id").alias(f"{s}_id"), F.col("req_id").alias(f"{s}_req_id")), s, "left")
    return out.drop("source", "target")


@contextmanager
def timed(durations: dict[str, float], stage: str) -> Iterator[None]:
    """Milliseconds that a stage took, also where it failed. What Spark leaves lazy is not in them."""
    begun = time.perf_counter()
    try:
        yield
    finally:
        durations[stage] = round(1000 * (time.perf_counter() - begun), 3)
