"""Near-duplicate self-join on word shingles by token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .components import components
from .scratch import Scratch, one_per_id

#: A fixed number of counters in each of two hashed rows; the sketch has the same size for any corpus.
_BUCKETS = 1 << 20
_SLICES = 32
#: Sets of a component that are counted against each other at a time.
_BLOCK = 256
#: Pivot rounds before what is left of an index entry is compared in full.
_PIVOTS = 3
#: Tokens that more than one in so many members' differences from the pivot hold are counted; they are 50 times a mean difference at most.
_OFTEN = 50


def _rows(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (token >> np.uint64(44)).astype(np.int64), ((token >> np.uint64(20)) & np.uint64(_BUCKETS - 1)).astype(np.int64)


def _sets(off: np.ndarray, data: np.ndarray, n: int) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Of each run of rows: the distinct sorted shingle hashes, the word hashes and their bounds."""
    for i, j in spans.pieces(off):
        bounds = off[i : j + 1] - off[i]
        g, at, h, first = spans.shingles(data[off[i] : off[j]], bounds, n)
        row = np.repeat(np.arange(j - i), np.diff(at))
        order = np.argsort(g, kind="stable")
        order = order[np.argsort(row[order], kind="stable")]
        g, row = g[order], row[order]
        if len(g):
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
            g, row = g[new], row[new]
        yield i, j, np.split(g, np.searchsorted(row, np.arange(1, j - i))), h, first


def shingle_load(docs: DataFrame, n: int = 3) -> np.ndarray:
    """The counters of the shingle sketch over all documents: an int64 array (2, 2^20), of fixed size."""

    def count(batches):
        total = np.zeros((2, _BUCKETS), np.int64)
        for b in batches:
            for _, _, sets, _, _ in _sets(*spans.buffers(b.column(0)), n):
                for r, at in enumerate(_rows(np.concatenate(sets))):
                    total[r] += np.bincount(at, minlength=_BUCKETS)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "load": pa.array([squeeze(x.astype(np.uint32).tobytes()) for x in total.reshape(_SLICES, -1)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(2 * _BUCKETS // _SLICES, np.int64)
        for x in table.column("load"):
            total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), np.uint32)
        return pa.table({"slice": table.column("slice").slice(0, 1), "load": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(spans.tidy(count), "slice int, load binary")
    got = {r["slice"]: np.frombuffer(r["load"], np.int64) for r in parts.groupBy("slice").applyInArrow(add, "slice int, load binary").collect()}
    if not got:
        return np.zeros((2, _BUCKETS), np.int64)
    return np.concatenate([got[k] for k in range(_SLICES)]).reshape(2, _BUCKETS)


def load_classes(load: np.ndarray) -> np.ndarray:
    """Of each counter: 0 if two documents at most have its shingles, 1 up to one and a half times the mean load, and one more for every doubling."""
    mean = np.maximum(load.mean(axis=1, keepdims=True), 1)
    over = np.ceil(np.log2(np.maximum(load / (1.5 * mean), 1))).astype(np.uint8)
    return np.where(load <= 2, 0, 1 + over).astype(np.uint8)


def _ceil(num: int, part: int, of: int) -> int:
    return -(-num * part // of)


def prefix_keys(tokens: np.ndarray, kind: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index entries of one sorted token set at Jaccard num/den (over a half); kind: the tokens' frequency classes.

    Tokens are ordered by frequency class, by hash within a class.
    The tokens that two linked sets do not share are at most
    size * (1 - t) / t together, and each of them stands between at most two
    shared tokens. So of the first k = that + 2 shared tokens, two follow
    each other directly in both sets, and the prefix that is extended to
    hold k shared tokens has them: its pairs of neighbours are the index
    entries. Where the sketch shows that two documents at most have the
    first token of a pair, that token alone is the entry. Sets so small that
    they may share fewer than k tokens have all tokens as entries too.
    """
    size = len(tokens)
    if not size:
        return tokens
    spare = size - _ceil(num, size, den)
    take = min(size, spare + size * (den - num) // num + 2)
    by = np.argsort(kind, kind="stable")[:take]
    order, alone = tokens[by], kind[by] == 0
    first, second = order[:-1], order[1:]
    keys = [np.where(alone[:-1], spans.mix(first + np.uint64(1)), spans.mix(spans.mix(first) + second))]
    if size * (2 * num - den) < 2 * den or size == 1:
        keys.append(spans.mix(order + np.uint64(2)))
    return np.unique(np.concatenate(keys))


def index(docs: DataFrame, load: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, sig1, sig2, central, keys) of every document; central: the mean frequency class of its tokens in thousandths, highest for the member of a group of near copies that has the fewest words of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(load_classes(load))

    def work(batches):
        kinds = shared.value
        for b in batches:
            ids = b.column(0)
            for i, j, sets, h, first in _sets(*spans.buffers(b.column(1)), n):
                place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first)) if len(h) else np.zeros(0, np.int64)
                sums = []
                for salt in (1, 2):
                    c = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(spans.mix(h + spans.mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt))), out=c[1:])
                    sums.append((c[first[1:]] - c[first[:-1]]).view(np.int64))
                keys, central = [], []
                for s in sets:
                    r, q = _rows(s)
                    kind = np.minimum(kinds[0][r], kinds[1][q])
                    central.append(int(1000 * kind.mean()) if len(s) else 0)
                    keys.append(prefix_keys(s, kind, num, den).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32()), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(central, pa.int32()), lists], ["doc_id", "n_shingles", "sig1", "sig2", "central", "keys"])

    return docs.select("doc_id", "text").mapInArrow(spans.tidy(work), "doc_id long, n_shingles long, sig1 long, sig2 long, central int, keys array<long>")


def _tokens(docs: DataFrame, n: int) -> DataFrame:
    """(id, tokens): sorted distinct shingle hashes as bytes."""

    def work(batches):
        for b in batches:
            for i, j, sets, _, _ in _sets(*spans.buffers(b.column(1)), n):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(spans.tidy(work), "id long, tokens binary")


def _verify(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of those pairs whose sets reach the similarity, by counting the intersection exactly."""

    def work(batches):
        for b in batches:
            left, right = b.column(2), b.column(3)
            keep = []
            for x, y in zip(left, right, strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                both = int((t[at] == s).sum()) if len(t) else 0
                keep.append(both > 0 and den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(tokens.select(F.col("id").alias("a"), F.col("tokens").alias("s")), "a")
    two = one.join(tokens.select(F.col("id").alias("b"), F.col("tokens").alias("t")), "b")
    return two.select("a", "b", "s", "t").mapInArrow(spans.tidy(work), "a long, b long")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), pa.int64()))


def _compare(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(x, p, x_size, p_size, linked, near, diff) of the pairs (x, p) in whose sets a partner of a near member can be.

    near: similarity of a half at least. Jaccard distance is a metric, so
    what links with a near member is within a half less 1 - num/den of p:
    those pairs are returned. diff holds the tokens that one of the two
    sets has alone, the last bit 0 if x has it, 1 if p has it.
    """

    def work(batches):
        for b in batches:
            keep, linked, near, diff, sizes = [], [], [], [], ([], [])
            for k, (u, v) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                s, t = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                at = np.searchsorted(t, s)
                at[at == len(t)] = 0
                here = t[at] == s if len(t) else np.zeros(len(s), bool)
                both = int(here.sum())
                whole = len(s) + len(t) - both
                if 2 * den * both < (2 * num - den) * whole:
                    continue
                there = np.ones(len(t), bool)
                there[at[here]] = False
                keep.append(k)
                linked.append(den * both >= num * whole)
                near.append(2 * both >= whole)
                diff.append(np.concatenate([s[~here] & ~np.uint64(1), t[there] | np.uint64(1)]).view(np.int64))
                sizes[0].append(len(s))
                sizes[1].append(len(t))
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pick), b.column(1).take(pick), *[pa.array(z, pa.int64()) for z in sizes], pa.array(linked, pa.bool_()), pa.array(near, pa.bool_()), _lists(diff)], ["x", "p", "x_size", "p_size", "linked", "near", "diff"])

    one = pairs.join(tokens.select(F.col("id").alias("x"), F.col("tokens").alias("s")), "x")
    two = one.join(tokens.select(F.col("id").alias("p"), F.col("tokens").alias("t")), "p")
    return two.select("x", "p", "s", "t").mapInArrow(spans.tidy(work), "x long, p long, x_size long, p_size long, linked boolean, near boolean, diff array<long>")


def _group_candidates(tested: DataFrame, scratch: Scratch, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Links and further candidates (a, b) among the documents that were compared with one pivot.

    The symmetric difference of two sets is that of their differences from
    any third set, the centre. The centre is the pivot with the tokens
    swapped in or out that most members' differences hold. Near copies of one text then have few tokens left, mostly their
    own. Two sets link just when their symmetric difference is at most
    c * (sum of sizes), c = (den - num) / (den + num), that is when their
    differences D share at least (f + g) / 2 tokens, with f = |D| - c * size.
    With z the member of least f, those with f + f(z) <= 0 link with z for
    certain, and so do both of any two that need to share no token. For all
    others the first shared token, in an order that all members of the group
    use (rare ones first), stands so early in both that the needed number can still follow:
    these are the candidates. Equal (pivot, token) pairs are joined, so no
    task holds a group.
    """
    c_of, c_num = den + num, den - num
    several = tested.groupBy("p").agg(F.count("*").alias("n"), F.min("linked").alias("all"), F.first("p_size").alias("p_size")).where("n > 1 and not all")
    several = scratch.table(several.select("p", "n", "p_size"), "groups")
    if several.isEmpty():
        scratch.drop(several)
        return None, None
    rest = tested.join(several.select("p", "n"), "p").select("p", "n", F.col("x").alias("x"), F.col("x_size").alias("size"), "diff")
    rest = scratch.table(rest.unionByName(several.select("p", "n", F.col("p").alias("x"), F.col("p_size").alias("size"), F.array().cast("array<long>").alias("diff"))), "diffs")
    often = rest.select("p", "n", F.explode("diff").alias("item")).groupBy("p", "item").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(f"{_OFTEN} * k > n")
    often = often.groupBy("p").agg(F.collect_list(F.struct("item", "k")).alias("l"))
    swap = scratch.table(often.select("p", F.col("l.item").alias("often"), F.col("l.k").alias("times")), "swaps")

    def recentre(batches):
        for b in batches:
            own, d, f = [], [], []
            for diff, size, n, often, times in zip(b.column(3), b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5), b.column(6), strict=True):
                t = diff.values.to_numpy(zero_copy_only=False).view(np.uint64)
                seen = np.zeros(len(t), np.int64)
                if often.is_valid:
                    item, k = often.values.to_numpy(zero_copy_only=False).view(np.uint64), times.values.to_numpy(zero_copy_only=False)
                    most = 2 * k > n + 1
                    t = np.setxor1d(t, item[most])
                    by = np.argsort(item)
                    item, k = item[by], np.where(most, n - k, k)[by]
                    at = np.minimum(np.searchsorted(item, t), len(item) - 1)
                    seen = np.where(item[at] == t, k[at], 0)
                own.append(t[np.lexsort((t, t & np.uint64(1), seen))].view(np.int64))
                d.append(len(t))
                f.append(c_of * len(t) - c_num * size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.int64()), pa.array(f, pa.int64()), _lists(own)], ["p", "x", "d", "f", "own"])

    moved = rest.join(swap, "p", "left").select("p", "x", "size", "diff", "n", "often", "times").mapInArrow(spans.tidy(recentre), "p long, x long, d long, f long, own array<long>")
    moved = scratch.table(moved, "centred")
    least = scratch.table(moved.groupBy("p").agg(F.min(F.struct("f", "x")).alias("z")).select("p", F.col("z.f").alias("zf"), F.col("z.x").alias("z")), "centres")
    placed = moved.join(least, "p").withColumn("close", F.expr("f + zf <= 0"))
    sure = placed.where("close and x <> z").select(F.least("x", "z").alias("a"), F.greatest("x", "z").alias("b"))
    need = f"greatest(1, ceil((f + if(close, 1 - zf, zf)) / {2 * c_of}))"
    prefix = placed.withColumn("take", F.expr(f"cast(d - {need} + 1 as int)")).where("take > 0")
    items = scratch.table(prefix.select("p", "x", "d", "f", "close", F.posexplode(F.expr("slice(own, 1, take)")).alias("at", "item")), "items")
    a, b = (items.select("p", "item", *[F.col(k).alias(f"{s}_{k}") for k in ("x", "d", "f", "close", "at")]) for s in "ab")
    share = f"ceil((a_f + b_f) / {2 * c_of})"
    maybe = a.join(b, ["p", "item"]).where(f"a_x < b_x and not (a_close and b_close) and a_at + {share} <= a_d and b_at + {share} <= b_d").select(F.col("a_x").alias("a"), F.col("b_x").alias("b"))
    maybe = scratch.table(maybe.distinct(), "maybe")
    sure = scratch.table(sure.distinct(), "sure")
    scratch.drop(several, rest, swap, moved, least, items)
    return sure, maybe


def link_counts(group: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n_links) of every node of group(node, component): all sets of its component that reach the similarity with its own.

    Linked sets are in one component, so all pairs there are all that can
    link. A component is dealt into blocks by hash, and every pair of blocks
    is a group of its own, so a large component spreads over tasks.
    """
    sized = group.join(group.groupBy("component").agg(F.ceil(F.count("*") / _BLOCK).alias("blocks")), "component")
    dealt = sized.join(tokens, F.col("node") == F.col("id")).select("component", "id", "tokens", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "blocks")
    other = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pairs = other.select("component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "tokens")

    def count(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x, y, block = (t.column(c).to_numpy() for c in ("x", "y", "block"))
        ids, sets = t.column("id").to_numpy(), [np.frombuffer(s.as_buffer(), np.uint64) for s in t.column("tokens")]
        size = np.array([len(s) for s in sets])
        linked = np.zeros(len(ids), np.int64)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        if len(left) and len(right):
            _, token = np.unique(np.concatenate(sets), return_inverse=True)
            row, n = np.repeat(np.arange(len(ids)), size), int(token.max()) + 1
            both = np.zeros((len(left), len(right)), np.int64)
            for at in range(0, n, 1 << 13):
                some = (token >= at) & (token < at + (1 << 13))
                has = np.zeros((len(ids), min(1 << 13, n - at)), np.float32)
                has[row[some], token[some] - at] = 1
                both += (has[left] @ has[right].T).astype(np.int64)
            near = (both > 0) & (den * both >= num * (size[left][:, None] + size[right][None, :] - both)) & (ids[left][:, None] != ids[right][None, :])
            np.add.at(linked, left, near.sum(axis=1))
            if x[0] != y[0]:
                np.add.at(linked, right, near.sum(axis=0))
        return pa.table({"rep": t.column("id"), "n": pa.array(linked)})

    return pairs.groupBy("component", "x", "y").applyInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n_links"))


def ngram_join(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """Near-duplicate groups of docs(doc_id, text): every text's class and its links.

    Words are runs of other than ASCII white space, A-Z lower-cased. A
    document's set holds the hashes (64 bits) of its distinct n-word
    shingles; with fewer words the whole sequence is the one shingle. Two
    documents link when |intersection| * den >= |union| * num.

    1. Documents with one word sequence (128-bit signature) become one class;
       only its least doc_id goes on, so a group of copies costs one row.
    2. A sketch of fixed size, counted over all documents, puts frequent
       shingles last in the order of tokens and proves some rare. Extended
       prefixes are indexed by pairs of neighbouring tokens, or by the one
       token where it is rare (prefix_keys).
    3. An entry's documents are not all paired. In each of three rounds one
       of them, the pivot, is compared with the others. Those at least half
       alike are compared among themselves by what they differ in from the
       pivot (_group_candidates), which near copies of one text share little
       of; those less alike go on to the next round. What is left then is
       compared in full, but for pairs that are connected already. Nothing
       that can link is left out.
    4. Links are counted apart from that, over all pairs of a component's
       classes (link_counts): their work grows with the square of a
       component, as the links themselves do.

    Returns doc_id, n_shingles, class_id (least doc_id of the same word
    sequence), n_links (of the class's representative: to how many other classes'
    representatives it links, all of them) and
    component_id (least doc_id reachable). Null and empty texts and texts
    without a word have n_shingles 0 and link with nothing. Rows with a null
    doc_id are left out, repeated doc_ids give one row (for the least of
    their texts); further columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    if 2 * similarity[0] <= similarity[1]:
        raise ValueError("the similarity must be over a half")
    num, den = similarity[0] // gcd(*similarity), similarity[1] // gcd(*similarity)
    docs, _ = one_per_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"))
    indexed = scratch.table(index(docs, shingle_load(docs, n), n, num, den), "index")
    found = scratch.table(indexed.drop("keys"), "found")
    same = indexed.where("n_shingles > 0").groupBy("sig1", "sig2", "n_shingles")
    classes = scratch.table(same.agg(F.min("doc_id").alias("rep"), F.first("central").alias("central"), F.first("keys").alias("keys")), "classes")
    entries = classes.select("rep", F.col("n_shingles").alias("size"), "central", F.explode("keys").alias("key"))
    scratch.drop(indexed)
    used = scratch.table(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    scratch.drop()
    left = scratch.table(entries.join(used, "key").select("key", "rep", "size", "central"), "entries")
    reps = scratch.table(classes.drop("keys"), "reps")
    scratch.drop(classes, used)
    member = found.join(reps.select("sig1", "sig2", "rep"), ["sig1", "sig2"], "left")
    ids = left.select(F.col("rep").alias("doc_id")).distinct()
    tokens = scratch.table(_tokens(docs.join(ids, "doc_id", "left_semi"), n), "tokens")

    def joined(new: DataFrame | None) -> None:
        nonlocal links, group
        if new is not None and not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            group = components(links, scratch)

    links, group = None, None
    for _ in range(_PIVOTS):
        now = left.withColumn("c", F.col("rep")) if group is None else left.join(group.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
        rank = F.struct("central", F.xxhash64("rep").alias("h"), "rep", "size")
        lead = scratch.table(now.groupBy("key").agg(F.max(rank).alias("l"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", F.col("l.rep").alias("p"), F.col("l.size").alias("p_size")), "pivots")
        met = scratch.table(left.join(lead, "key").where("rep <> p"), "met")
        scratch.drop(left, lead)
        pairs = scratch.table(met.where(f"least(size, p_size) * {2 * den} >= greatest(size, p_size) * {2 * num - den}").select(F.col("rep").alias("x"), "p").distinct(), "pairs")
        tested = scratch.table(_compare(pairs, tokens, num, den), "tested")
        scratch.drop(pairs)
        straight = scratch.table(tested.where("linked").select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b")), "links")
        near = tested.where("near").select(F.col("x").alias("rep"), "p")
        left = scratch.table(met.join(near, ["rep", "p"], "left_anti").select("key", "rep", "size", "central"), "entries")
        scratch.drop(met)
        sure, maybe = _group_candidates(tested, scratch, num, den)
        scratch.drop(tested)
        new = straight
        if sure is not None:
            new = straight.unionByName(sure).unionByName(scratch.table(_verify(maybe, tokens, num, den), "links"))
        joined(new)
        if left.isEmpty():
            break
    else:
        now = left.withColumn("c", F.col("rep")) if group is None else left.join(group.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component")
        now = scratch.table(now, "now")
        a, b = (now.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("rep", "size", "c")]) for p in "ab")
        pairs = a.join(b, "key").where(f"a_rep < b_rep and a_c <> b_c and least(a_size, b_size) * {den} >= greatest(a_size, b_size) * {num}")
        pairs = scratch.table(pairs.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b")).distinct(), "pairs")
        scratch.drop(now)
        joined(scratch.table(_verify(pairs, tokens, num, den), "links"))
    if group is None:
        ends = reps.select("rep", F.lit(0).cast("long").alias("n_links"), F.col("rep").alias("component_id"))
    else:
        counts = scratch.table(link_counts(group, tokens, num, den), "counts")
        ends = scratch.table(counts.join(group.select(F.col("node").alias("rep"), F.col("component").alias("component_id")), "rep"), "ends")
    scratch.drop(tokens)
    return member.join(ends, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"),
    )
