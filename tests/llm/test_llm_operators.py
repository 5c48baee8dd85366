"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import id_coder, line_dedup, queries, warc, webp
from tessella.llm.license_scan import license_scan
from tessella.llm.media import media_columns, read_pixels, store
from tessella.llm.ngram_join import ngram_join
from tessella.llm.packing import best_fit, pack, plan
from tessella.llm.quality_rules import quality_rules
from tessella.llm.toxicity import score, train
from tessella.llm.word_table import word_table_codec
from tessella.llm.id_files import token_files

WORD, BYTE = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
AWKWARD = [None, "", "  \n\t ", "one", "Two words", "Don't STOP! İstanbul ﬁ é́ <|endoftext|>x  y\r\n\x0b z", "\x1c\x85 　 a", "same text here", "same text here", "\n\n", "x" * 3000, "word " * 4000, "a b c\n" * 30]
LONG = " ".join(f"w{i * i % 977}" for i in range(9000))


def awkward(spark, texts=(*AWKWARD, LONG)):
    """Nulls, empty and long texts, repeated rows, a null id, and columns with the names that operators use."""
    rows = [(i, t, None, "s") for i, t in enumerate(texts)] + [(7, "same text here", None, "s"), (None, "text without an id", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("keys", "rep", "line", "score", "kept", "n_words", "starts", "stops", "length", "ids", "id", "part", "licenses", "media", "n_lines", "block", "words", "toxic")})


def clean(spark, texts=(*AWKWARD, LONG)):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def test_quality_counts_match_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    for name in ("op2_quality_rules", "op6_license_scan"):
        df = queries.queries()[name](spark, data)
        cursor = con.execute(queries.oracle_sql()[name])
        names = [x[0] for x in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cursor.fetchall())


def test_quality_awkward(spark):
    t = clean(spark)
    got = {r["doc_id"]: r for r in quality_rules(t).collect()}
    for i, text in enumerate((*AWKWARD, LONG)):
        w = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
        seen = defaultdict(list)
        for k in range(len(w) - 2):
            seen[tuple(w[k : k + 3])].append(k)
        hit = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(3)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit)), i
    assert quality_rules(awkward(spark)).count() == len(AWKWARD) + 3 and quality_rules(empty(spark)).count() == 0
    assert quality_rules(awkward(spark)).where("kept").count() >= 0


def test_quality_rules_lines(spark):
    good = "This sentence has a number of ordinary words in it and so it stays with the others as it is. "
    text = "\n".join([good * 3, "home | news | sport | weather | more", "A### b$$$ c%%% d***", "ALL OF THESE WORDS ARE SHOUTED", "please accept cookies", good * 2 + "Each of them counts."])
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["clean_text"].split("\n") == [good * 3, good * 2 + "Each of them counts."]


def brute_runs(docs, least):
    lines = [(d, k, x) for d, t in sorted(docs) for k, x in enumerate(t.split("\n"))]
    end = [0] * len(lines)
    for i in reversed(range(len(lines))):
        end[i] = i + 1 if i + 1 == len(lines) or lines[i + 1][0] != lines[i][0] else end[i + 1]
    gone = [False] * len(lines)
    for i in range(len(lines)):
        best = 0
        for j in range(i):
            n = 0
            while i + n < end[i] and j + n < end[j] and lines[i + n][2] == lines[j + n][2]:
                n += 1
            best = max(best, n)
        if best and sum(len(lines[i + k][2].encode().split()) for k in range(best)) >= least:
            gone[i : i + best] = [True] * best
    out = {d: [] for d, _ in docs}
    for (d, _, x), g in zip(lines, gone, strict=True):
        if not g:
            out[d].append(x)
    return {d: "\n".join(x) for d, x in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    docs = [(int(d), "\n".join(f"l{x} a b" for x in rng.integers(0, 3 + seed * 2, rng.integers(1, 14)))) for d in rng.permutation(25)]
    docs += [(100 + i, docs[3][1]) for i in range(3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), 7).collect()}
    assert got == brute_runs(docs, 7)


def test_line_dedup_awkward(spark):
    out = line_dedup.line_dedup(awkward(spark), 5)
    assert out.count() == len(AWKWARD) + 3 and out.where("text IS NULL").count() == 1
    assert line_dedup.line_dedup(empty(spark)).count() == 0


def brute_components(docs, n, num, den):
    sets = {}
    for d, t in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10), (1, 2, 3)])
def test_ngram_join_brute_force(spark, n, num, den):
    rng = np.random.default_rng(n)
    docs = [(i, t) for i, t in enumerate((*AWKWARD, LONG))]
    for base in range(6):
        words = [f"{'abc'[base % 3]}{x}" for x in rng.integers(0, 400, rng.integers(4, 120))]
        for _ in range(9):
            copy = list(words)
            for k in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[k] = f"new{rng.integers(0, 99)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + i, " ".join(f"z{x}" for x in rng.integers(0, 4, rng.integers(1, 6)))) for i in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), n, (num, den)).collect()}
    assert got == brute_components(docs, n, num, den)


def test_ngram_join_awkward(spark):
    out = ngram_join(awkward(spark))
    assert out.count() == len(AWKWARD) + 1 and ngram_join(empty(spark)).count() == 0


def test_toxicity_held_out(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet")
    out = queries.op9_toxicity(spark, data.replace("sf0.001", "sf0.01")).join(labels, "doc_id").where("held_out").collect()
    right = [(r["predicted"] == 1) == (r["toxic"] == 1) for r in out]
    assert np.mean(right) > 0.9
    model = train(docs.limit(0), labels)
    assert all(0 <= r["score"] <= 1 for r in score(awkward(spark), model).collect())
    assert score(awkward(spark), train(awkward(spark), awkward(spark).select("doc_id", "toxic"))).count() == len(AWKWARD) + 3


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    return t


def test_word_table(spark):
    t, docs = library(WORD), (*AWKWARD, LONG)
    for r in word_table_codec(clean(spark), WORD, "full").collect():
        ids = t.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert word_table_codec(awkward(spark), WORD).count() == len(AWKWARD) + 3 and word_table_codec(empty(spark), WORD).count() == 0


def test_packing(spark):
    t, docs = library(WORD), (*AWKWARD, LONG)
    rows = pack(clean(spark), WORD, keep_ids=True).collect()
    for d, text in enumerate(docs):
        mine = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["piece"])
        ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in mine), "<u4").tolist()
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r["start"] for r in mine] == [2048 * i for i in range(len(mine))] and all(r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) for r in mine)
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 2048
    assert pack(awkward(spark), WORD).select("doc_id").count() >= len(AWKWARD) + 3 and pack(empty(spark), WORD).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    demand = np.bincount(np.minimum(256, (rng.exponential(60, 20_000) + 1).astype(int)), minlength=257)
    p = plan(demand, 256)
    bound = -(-int((demand * np.arange(257)).sum()) // 256)
    assert bound <= p.sequences <= bound + 3 and p.sequences <= sum(best_fit(demand, 256).values())


def test_token_files(spark):
    t, at = library(BYTE), 0
    got = {r["doc_id"]: r for r in token_files(clean(spark), BYTE).collect()}
    for d, text in enumerate((*AWKWARD, LONG)):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files(awkward(spark), BYTE).count() == len(AWKWARD) + 2 and token_files(empty(spark), BYTE).count() == 0


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 50257, 700), np.zeros(0, np.int64), np.full(900, 7), np.array([id_coder.MAX_ID, 0]), np.tile(np.arange(50), 20), rng.zipf(1.3, 900).clip(0, 50000)]
    blocks = [b.astype(np.uint32) for b in blocks]
    coded = id_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, id_coder.decode(coded), strict=True))
    assert len(coded[4]) < 4 * 1000 / 3
    broken = bytearray(coded[0])
    broken[100] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        id_coder.decode([bytes(broken)])
    with pytest.raises(ValueError):
        id_coder.encode([np.array([id_coder.MAX_ID + 1], np.uint32)])


OPTIONS = [{}, {"matches": False}, {"cache": 6}, {"predictor": 14}, {"cross": (-20, 17, 90)}, {"subtract_green": True}, {"palette": True}, {"palette": True, "predictor": 2}, {"predictor": 11, "cross": (5, -9, 33), "subtract_green": True, "cache": 10, "bits": 2}]


@pytest.mark.parametrize("options", OPTIONS)
def test_webp_round_trip(options):
    rng = np.random.default_rng(2)
    images = [rng.choice(np.array([0xFF000000, 0xFF00FF00, 0x80123456, 0xFFFFFFFF], np.uint32), (h, w)) for h, w in ((1, 1), (5, 1), (1, 9), (13, 17))]
    if "palette" not in options:
        images.append(rng.integers(0, 1 << 32, (20, 21), dtype=np.uint32))
    found = webp.decode_images([webp.encode_image(x, **options) for x in images])
    assert all(np.array_equal(a, b) for a, b in zip(images, found, strict=True))


def test_webp_damage():
    f = webp.encode_image(np.arange(64, dtype=np.uint32).reshape(8, 8))
    with pytest.raises(ValueError):
        webp.decode_images([f[:30]])
    with pytest.raises(ValueError):
        webp.decode_images([b"RIFF" + f[4:8] + b"WEBPVP8 " + f[16:]])


def test_media(spark):
    docs = (*AWKWARD, LONG)
    for r in media_columns(clean(spark)).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    pixels = read_pixels(store(clean(spark, ["abc"]))).first()
    assert (pixels["width"], pixels["height"], len(pixels["pixels"]), pixels["pixels"][0]) == (192, 1, 192, 0xFF616263)
    assert media_columns(awkward(spark)).count() == len(AWKWARD) + 3 and media_columns(empty(spark)).count() == 0


def test_warc(spark):
    page = '<!DOCTYPE html><title>A &amp; B</title><script>var a="</p>";</script><!-- x --><p>One &lt;b&gt;<br>two  three<a href="/x?a=1&amp;b">l</a><img src=\'i.png\'></p>'
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (3, "http://c/\n", "plain"), (1, "http://a/", page), (4, "u", "<p>é" * 40000)], "page_id long, url string, html string").withColumns({"record": F.lit(1), "metadata": F.lit(2)})
    made = warc.derivatives(warc.responses(pages)).collect()
    assert len(made) == 5 and made[0]["error"] is None
    first = next(r for r in made if r["page_id"] == 1)
    (meta,), (conv,) = (list(warc.parse_records(bytes(first[c]))) for c in ("metadata", "conversion"))
    assert conv.block.decode() == "A & B\nOne <b>\ntwo threel" and first["n_links"] == 2 and first["title"] == "A & B"
    source = warc.response(1, "http://a/", page, "1970-01-01T00:00:00Z")
    assert meta.headers["WARC-Refers-To"] == conv.headers["WARC-Refers-To"] == source.headers["WARC-Record-ID"]
    assert meta.headers["WARC-Target-URI"] == "http://a/" and first["source_digest"] == source.headers["WARC-Payload-Digest"]
    assert conv.headers["WARC-Block-Digest"] == warc.digest(conv.block)
    bad = spark.createDataFrame([(1, b"nothing"), (2, None), (3, source.to_bytes()[:-9])], "page_id long, record binary")
    assert [r["error"] is not None for r in warc.derivatives(bad).collect()] == [True] * 3
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_license_scan(spark):
    t = spark.createDataFrame([(1, "Some words.\nReleased under the MIT License.\nMore words."), (2, "Licensed under CC BY-SA 4.0."), (3, "no licence here"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in license_scan(t).collect()} == {1: ["MIT"], 2: ["CC-BY-SA-4.0"], 3: [], 4: []}
    assert license_scan(awkward(spark)).where("n_matches >= 0").count() == len(AWKWARD) + 3 and license_scan(empty(spark)).count() == 0


def test_pipeline(spark, data):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), data).count() == 0
        ids = [r[0] for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and 0 < len(ids) <= docs.count()
    assert corpus_pipeline.run(spark, data).count() > 0
