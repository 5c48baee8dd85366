"""Repeated runs of lines by a distributed suffix array over line ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .scratch import Scratch, one_per_id, partitions

_POS = "doc_id long, line long"


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, line, h1, h2, before, n_words): every line with a 128-bit hash of its bytes, the words before it in its document, and its own words."""

    def work(batches):
        for b in batches:
            off, data = spans.buffers(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in spans.pieces(off):
                part, bounds = data[off[i] : off[j]], off[i : j + 1] - off[i]
                breaks = np.flatnonzero(part == 10)
                row = np.concatenate([np.arange(j - i), np.searchsorted(bounds, breaks, "right") - 1])
                starts, ends = np.concatenate([bounds[:-1], breaks + 1]), np.concatenate([breaks, bounds[1:]])
                starts, ends, row = np.sort(starts), np.sort(ends), np.sort(row)
                first = np.searchsorted(row, np.arange(j - i))
                w = spans.words(part, bounds)[0]
                n, base = np.searchsorted(w, ends) - np.searchsorted(w, starts), np.searchsorted(w, starts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids[i:j][row], "line": np.arange(len(row)) - first[row],
                    "h1": spans.span_hash(part, starts, ends).view(np.int64), "h2": spans.span_hash(part, starts, ends, seed=12).view(np.int64),
                    "before": base - base[first][row], "n_words": n,
                })

    return docs.select("doc_id", "text").mapInArrow(work, _POS + ", h1 long, h2 long, before long, n_words long")


def _split(df: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """Refine the classes of df(doc_id, line, rank, *keys): rank becomes the rank plus the number of the class's rows with smaller keys; alone says whether a row is now single.

    One range sort over (rank, keys, position), so that a class or a key of
    any size spreads over tasks; each task counts locally, and what reaches
    over a task's border is corrected from one summary row per task.
    """
    cols = ["rank", *keys]
    spread = df.repartitionByRange(partitions(df.sparkSession), *cols, "doc_id", "line").sortWithinPartitions(*cols, "doc_id", "line")

    def count(frames):
        from pyspark import TaskContext

        frames = [t for t in frames if len(t)]
        if not frames:
            return
        t = pd.concat(frames, ignore_index=True)
        rank = t["rank"].to_numpy()
        new_class = np.ones(len(t), bool)
        new_class[1:] = rank[1:] != rank[:-1]
        new_key = new_class.copy()
        for k in keys:
            v = t[k].to_numpy()
            new_key[1:] |= v[1:] != v[:-1]
        at = np.arange(len(t))
        class_at = np.maximum.accumulate(np.where(new_class, at, 0))
        key_no = np.cumsum(new_key) - 1
        key_at = np.flatnonzero(new_key)
        size = np.diff(np.append(key_at, len(t)))
        out = t[["doc_id", "line", "rank"]].assign(less=(key_at[key_no] - class_at).astype("int64"), alone=(size[key_no] == 1), first_class=class_at == 0, first_key=key_no == 0, last_key=key_no == key_no[-1], part=TaskContext.get().partitionId(), ends=(at == 0) | (at == len(t) - 1), total=len(t), trailing=int(len(t) - class_at[-1]), key_size=size[key_no])
        for k in keys:
            out[k] = t[k]
        yield out

    schema = _POS + ", rank long, less long, alone boolean, first_class boolean, first_key boolean, last_key boolean, part int, ends boolean, total long, trailing long, key_size long, " + ", ".join(f"{k} long" for k in keys)
    local = scratch.table(spread.mapInPandas(count, schema), "ranked")
    # one or two rows of each task: its first and last row
    edge = sorted(local.where("ends").collect(), key=lambda r: (r["part"], *(r[c] for c in cols), r["doc_id"], r["line"]))
    parts = sorted({r["part"] for r in edge})
    ends = {p: [r for r in edge if r["part"] == p] for p in parts}
    fixes, in_class, in_key, last = [], 0, 0, None
    for at, p in enumerate(parts):
        a, z = ends[p][0], ends[p][-1]
        ka, kz = tuple(a[c] for c in cols), tuple(z[c] for c in cols)
        if last is None or last[0] != ka[0]:
            in_class = 0
        joined = last == ka
        if not joined:
            in_key = 0
        follows = ends[parts[at + 1]][0] if at + 1 < len(parts) else None
        goes_on = follows is not None and tuple(follows[c] for c in cols) == kz
        # rows of the first class before this task, those of the first key among them, and whether the first and last key cross a border
        fixes.append((p, in_class, in_key if joined else 0, joined, goes_on))
        in_class = in_class + z["total"] if ka[0] == kz[0] else z["trailing"]
        in_key = (in_key if joined else 0) + z["total"] if ka == kz else z["key_size"]
        last = kz
    fix = df.sparkSession.createDataFrame(fixes or [(-1, 0, 0, False, False)], "part int, in_class long, in_key long, joined boolean, goes_on boolean")
    whole = local.join(F.broadcast(fix), "part")
    less = F.col("less") + F.when(F.col("first_class"), F.col("in_class")).otherwise(0) - F.when(F.col("first_key") & F.col("joined"), F.col("in_key")).otherwise(0)
    cross = (F.col("first_key") & F.col("joined")) | (F.col("last_key") & F.col("goes_on"))
    return whole.select("doc_id", "line", (F.col("rank") + less).alias("rank"), (F.col("alone") & ~cross).alias("alone"))


def suffix_array(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Of the positions whose line occurs more than once: (positions with their words, final ranks, ranks by prefix length 1, 2, 4, ...).

    A line that occurs once, and a document's end, are letters of their own;
    a suffix is settled as soon as its prefix is unlike all others, and only
    unsettled ones go into the next doubling.
    """
    again = scratch.table(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "again")
    base = scratch.table(lines.join(again, ["h1", "h2"]), "lines")
    rank = scratch.table(_split(base.select("doc_id", "line", F.lit(0).cast("long").alias("rank"), "h1", "h2"), ["h1", "h2"], scratch), "rank")
    levels, length = [rank], 1
    while not (open_ := rank.where("not alone")).isEmpty():
        second = rank.select("doc_id", (F.col("line") - length).alias("line"), F.col("rank").alias("k1"))
        keyed = open_.join(second, ["doc_id", "line"], "left").select(
            "doc_id", "line", "rank", F.coalesce("k1", F.lit(-1).cast("long")).alias("k1"),
            F.when(F.col("k1").isNull(), F.col("doc_id")).otherwise(0).alias("k2"), F.when(F.col("k1").isNull(), F.col("line")).otherwise(0).alias("k3"))
        finer = scratch.table(_split(keyed, ["k1", "k2", "k3"], scratch), "finer")
        rank = scratch.table(rank.where("alone").unionByName(finer), "rank")
        levels.append(rank)
        length *= 2
    return base.select("doc_id", "line", "before", "n_words"), rank, levels


def _ordered(rank: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, line, rank, p_doc, p_line, part, first): each suffix with its predecessor in the suffix array; a task's first row has that of the task before."""
    spread = rank.repartitionByRange(partitions(rank.sparkSession), "rank").sortWithinPartitions("rank")

    def pair(frames):
        from pyspark import TaskContext

        frames = [t for t in frames if len(t)]
        if frames:
            t = pd.concat(frames, ignore_index=True)
            yield t[["doc_id", "line", "rank"]].assign(p_doc=t["doc_id"].shift(1), p_line=t["line"].shift(1), part=TaskContext.get().partitionId(), first=t.index == 0, last=t.index == len(t) - 1)

    local = scratch.table(spread.select("doc_id", "line", "rank").mapInPandas(pair, _POS + ", rank long, p_doc long, p_line long, part int, first boolean, last boolean"), "order")
    tails = sorted((r["part"], r["doc_id"], r["line"]) for r in local.where("last").collect())
    heads = sorted(r["part"] for r in local.where("first").select("part").collect())
    fix = [(p, t[1], t[2]) for p, t in zip(heads[1:], tails, strict=False)] or [(-1, 0, 0)]
    fix = rank.sparkSession.createDataFrame(fix, "part int, q_doc long, q_line long")
    return local.join(F.broadcast(fix), "part", "left").select(
        "doc_id", "line", "rank", F.when(F.col("first"), F.col("q_doc")).otherwise(F.col("p_doc")).alias("p_doc"),
        F.when(F.col("first"), F.col("q_line")).otherwise(F.col("p_line")).alias("p_line"), "part")


def common_prefixes(order: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """order with lcp: the lines that a suffix shares with its predecessor, found by descending through the prefix classes."""
    pairs = scratch.table(order.withColumn("lcp", F.lit(0).cast("long")), "pairs")
    for k in reversed(range(len(levels))):
        side = levels[k].where("not alone").select("doc_id", "line", F.col("rank").alias("r"))
        mine = side.select("doc_id", F.col("line").alias("at"), F.col("r").alias("r1"))
        theirs = side.select(F.col("doc_id").alias("p_doc"), F.col("line").alias("p_at"), F.col("r").alias("r2"))
        look = pairs.withColumns({"at": F.col("line") + F.col("lcp"), "p_at": F.col("p_line") + F.col("lcp")})
        got = look.join(mine, ["doc_id", "at"], "left").join(theirs, ["p_doc", "p_at"], "left")
        new = scratch.table(got.select("doc_id", "line", "rank", "p_doc", "p_line", "part", (F.col("lcp") + F.when(F.col("r1") == F.col("r2"), F.lit(1 << k)).otherwise(0)).alias("lcp")), "lcp")
        scratch.drop(pairs)
        pairs = new
    return pairs


def _frontier(pos: list, lcp_in: list) -> list[tuple[int, tuple]]:
    """From rows nearest first, each with the smallest shared prefix from here to it: those whose position is less than all nearer ones'."""
    out, best = [], None
    for p, common in zip(pos, lcp_in, strict=True):
        if common <= 0:
            break
        if best is None or p < best:
            out.append((common, p))
            best = p
    return out


def earlier_matches(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, line, run): the most lines from a position on that also begin at an earlier position.

    The nearest suffixes on either side of the array that stand earlier in
    the corpus give the longest match. Each range of the array is one task
    with a stack; across its borders it is given, per side, the suffixes
    that can still matter there (ever shorter prefix, ever earlier position).
    """
    spark = pairs.sparkSession

    def edges(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rank")
        pos, lcp = list(zip(t["doc_id"], t["line"], strict=True)), t["lcp"].to_numpy()
        rev = np.minimum.accumulate(np.append(np.iinfo(np.int64).max, lcp[:0:-1]))
        right, left = _frontier(pos[::-1], rev.tolist()), _frontier(pos, np.minimum.accumulate(lcp).tolist())
        rows = [(int(t["part"].iloc[0]), side, i, int(min(c, 1 << 40)), int(p[0]), int(p[1]), int(lcp[0]), int(lcp.min())) for side, f in (("right", right), ("left", left)) for i, (c, p) in enumerate(f)]
        return pd.DataFrame(rows or [(int(t["part"].iloc[0]), "none", 0, 0, 0, 0, int(lcp[0]), int(lcp.min()))], columns=["part", "side", "i", "common", "doc_id", "line", "head", "least"])

    got = pairs.groupBy("part").applyInPandas(edges, "part int, side string, i int, common long, doc_id long, line long, head long, least long").collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r["part"], r["side"], r["i"])):
        x = by.setdefault(r["part"], {"right": [], "left": [], "head": r["head"], "least": r["least"]})
        if r["side"] != "none":
            x[r["side"]].append((r["common"], (r["doc_id"], r["line"])))

    def joined(near: list, far: list, limit: int) -> list:
        out = [*near]
        for c, p in far:
            if min(c, limit) > 0 and (not out or p < out[-1][1]):
                out.append((min(c, limit), p))
        return out

    parts, seeds, carry = sorted(by), {p: [[], []] for p in by}, []
    for i, p in enumerate(parts):  # suffixes left of p, with what they share with the last one before p
        seeds[p][0] = carry
        carry = joined(by[p]["right"], carry, by[p]["least"])
    carry = []
    for p in reversed(parts):  # suffixes right of p, with what they share with the last one of p
        seeds[p][1] = carry
        carry = joined(by[p]["left"], carry, by[p]["least"])
    shared = spark.sparkContext.broadcast(seeds)

    def match(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rank", ignore_index=True)
        before, after = shared.value[int(t["part"].iloc[0])]
        pos, lcp = list(zip(t["doc_id"], t["line"], strict=True)), t["lcp"].tolist()
        best = [0] * len(pos)
        for backwards in (False, True):
            # the stack has (position, what it shares with the suffix on top of it); positions grow to the top
            seed = after if backwards else before
            stack = [[p, c] for c, p in reversed(seed)]
            for n in range(len(pos)):
                i = len(pos) - 1 - n if backwards else n
                # what this suffix shares with the one handled before it
                if backwards:
                    c = lcp[i + 1] if n else (1 << 40)
                else:
                    c = lcp[i]
                least = c
                while stack:
                    least = min(least, stack[-1][1])
                    if stack[-1][0] < pos[i]:
                        break
                    stack.pop()
                if stack:
                    stack[-1][1] = least
                    best[i] = max(best[i], least)
                if not least and stack:
                    stack.clear()
                stack.append([pos[i], 1 << 40])
        return pd.DataFrame({"doc_id": t["doc_id"], "line": t["line"], "run": best})

    return pairs.groupBy("part").applyInPandas(match, _POS + ", run long")


def repeated_lines(docs: DataFrame, min_words: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_deleted, keep): for each document with lines to delete, their number and the ranges (first, n) of lines that stay."""
    scratch = scratch or Scratch(docs.sparkSession, "line-dedup")
    lines = scratch.table(line_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")), "all-lines")
    base, rank, levels = suffix_array(lines, scratch)
    pairs = common_prefixes(_ordered(rank, scratch), levels, scratch)
    runs = earlier_matches(pairs, scratch)
    rows = base.join(runs, ["doc_id", "line"]).repartition(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "line")

    def cover(batches):
        batches = [b for b in batches if len(b)]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        doc, line, before, n, run = (t.column(i).to_numpy() for i in range(5))
        at = np.arange(len(doc))
        stop = at + run
        said = np.where(run > 0, before[np.maximum(stop - 1, at)] + n[np.maximum(stop - 1, at)] - before, 0)
        reach = np.maximum.accumulate(np.where((run > 0) & (said >= min_words), stop, 0))
        gone = np.flatnonzero(reach > at)
        if not len(gone):
            return
        d, k = doc[gone], line[gone]
        start = np.ones(len(gone), bool)
        start[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1] + 1)
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(gone)) - 1
        owner = np.flatnonzero(np.append(True, d[s][1:] != d[s][:-1]))
        bounds = np.append(owner, len(s))
        yield pa.RecordBatch.from_arrays([
            pa.array(d[s][owner]), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(k[s])), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(k[e] + 1))],
            ["doc_id", "starts", "stops"])

    return rows.select("doc_id", "line", "before", "n_words", "run").mapInArrow(cover, "doc_id long, starts array<long>, stops array<long>")


def line_dedup(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """docs with later copies of repeated line runs deleted, and the columns n_lines and n_deleted.

    Lines are what stands between newlines, compared byte for byte. A run of
    lines that also begins at an earlier place (order: doc_id, then line;
    the copies may overlap) is deleted when it has min_words words or more;
    the first copy stays. Every suffix's longest earlier match is used, so
    runs are maximal and deletion does not depend on how rows are split.

    All input columns stay, with text replaced (a document that is deleted
    whole has the empty text). Null texts stay null, with n_lines 0; an
    empty text has one line. A null doc_id's text is left as it is. doc_id
    ought to be unique: rows with one doc_id and one text are treated alike, as
    one document; of different texts with one doc_id only the least is looked
    at, the others stay as they are. Input columns named n_lines or n_deleted
    are replaced.
    """
    docs = docs.drop("n_lines", "n_deleted")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    once, twice = one_per_id(mine)
    gone = repeated_lines(once, min_words).select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts"), F.col("stops").alias("__stops"))
    same = F.lit(True)
    if twice:
        # of rows with one doc_id, those that have the text that was looked at
        gone = gone.join(once.select(F.col("doc_id").alias("__id"), F.sha2("text", 256).alias("__of")), "__id")
        same = F.sha2("text", 256) == F.col("__of")
    lines = F.split("text", "\n")
    # keep[i] is the range from the end of the deleted range before to the start of the next
    both = docs.join(gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("__id")) & same, "left")
    kept = F.transform(F.array(lines), lambda a: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("__starts")), lambda i: F.slice(
        a, F.when(i == 0, 1).otherwise(F.get("__stops", i - 1) + 1).cast("int"),
        (F.when(i == F.size("__starts"), F.size(a)).otherwise(F.get("__starts", i)) - F.when(i == 0, 0).otherwise(F.get("__stops", i - 1))).cast("int")))), "\n"))
    deleted = F.aggregate(F.zip_with("__starts", "__stops", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    names = [c for c in docs.columns if c != "text"]
    out = both.select(*docs.columns, n.alias("n_lines"), F.when(F.col("__starts").isNull(), F.lit(0).cast("long")).otherwise(deleted).alias("n_deleted"), F.when(F.col("__starts").isNotNull(), F.get(kept, F.lit(0))).otherwise(F.col("text")).alias("__text"))
    return out.select(*[F.col("__text").alias("text") if c == "text" else F.col(c) for c in docs.columns], "n_lines", "n_deleted") if names or docs.columns else out
