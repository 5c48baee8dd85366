"""Pieces of power-of-two lengths against the library's own ids."""

import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
from test_llm_operators import AWKWARD, LONG, WORD, awkward, clean, empty
from tokenizers import Tokenizer

from tessella.llm.binary_split import binary_split, cuts, write_buckets


def library():
    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return t


def test_cuts_are_the_fewest_powers():
    for n in range(1, 3000):
        got = cuts(n, 512)
        assert [s for s, _ in got] == [0, *np.cumsum([x for _, x in got])[:-1]] and sum(x for _, x in got) == n
        assert all(x & (x - 1) == 0 and x <= 512 for _, x in got)
        assert len(got) == n // 512 + (n % 512).bit_count()


def test_every_id_in_one_piece(spark):
    t, texts = library(), (*AWKWARD, LONG)
    got = defaultdict(list)
    out = binary_split(clean(spark).repartition(3), WORD, keep_ids=True, batch_tokens=8192).collect()
    for r in out:
        assert r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096 and r["offset"] == 0 and r["ids_crc32"] == zlib.crc32(r["ids"])
        got[r["doc_id"]].append((r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    assert set(got) == set(range(len(texts)))
    for i, text in enumerate(texts):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        rows = sorted(got[i])
        assert [x for r in rows for x in r[2]] == want and {r[3] for r in rows} == {len(want)}
        assert [(r[0], r[1]) for r in rows] == list(cuts(len(want), 4096))
    # numbered without gaps, longest first; batches hold one length and are full but for a bucket's last
    assert sorted(r["sequence_id"] for r in out) == list(range(len(out)))
    ordered = sorted(out, key=lambda r: r["sequence_id"])
    assert all(a["length"] >= b["length"] and b["batch"] - a["batch"] in (0, 1) for a, b in pairwise(ordered))
    full = defaultdict(list)
    for r in out:
        full[r["batch"]].append(r["length"])
    assert all(len(set(x)) == 1 for x in full.values())
    last = {x[0]: b for b, x in sorted(full.items())}
    assert all(sum(x) == 8192 or last[x[0]] == b for b, x in full.items())


def test_buckets_are_written_and_read(spark, tmp_path):
    out = binary_split(clean(spark), WORD, keep_ids=True)
    write_buckets(out, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert sorted((r["sequence_id"], r["length"], bytes(r["ids"])) for r in back.collect()) == sorted((r["sequence_id"], r["length"], bytes(r["ids"])) for r in out.collect())
    assert (tmp_path / "buckets" / "length=4096").is_dir()


def test_awkward_rows(spark):
    n = binary_split(awkward(spark), WORD).groupBy("doc_id").count().count()
    assert n == len(AWKWARD) + 2  # every id, and the null one
    twice = binary_split(awkward(spark), WORD).where("doc_id = 7").collect()
    assert len(twice) == 2 * len(binary_split(clean(spark), WORD).where("doc_id = 7").collect())
    assert binary_split(empty(spark), WORD).count() == 0
