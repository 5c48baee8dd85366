"""Features, training statistics and scores of the classifier against plain Python; ranking on held-out rows."""

import math

import numpy as np
import pyarrow as pa

from tessella.llm import queries, spans, toxicity
from tessella.llm.toxicity import features, score, train

TEXTS = [None, "", "a", "Ab\tcd", "Привет, мир!", "你好世界你好世界", "one two one two", "x" * 50, "é ﬁ \U0001f600 ok"]


def brute(text):
    t = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "").lower())
    t, out = f" {t} ", set()
    for n in (4, 5, 6):
        for i in range(len(t) - n + 1):
            code = sum(ord(c) * pow(0xD6E8FEB86659FD93, k, 1 << 64) for k, c in enumerate(t[i : i + n])) % (1 << 64)
            out.add((code * (0x9E3779B97F4A7C15 + 2 * n)) % (1 << 64) >> 46)
    return out


def test_features_are_character_grams(monkeypatch):
    off, data = spans.buffers(pa.array(TEXTS))
    row, f = features(off, data, 0, len(TEXTS))
    assert [set(f[row == i].tolist()) for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]
    long = "Grüße an alle, " * 40
    off, data = spans.buffers(pa.array([long]))
    monkeypatch.setattr(toxicity, "_PIECE", 64)
    assert set(features(off, data, 0, 1)[1].tolist()) == brute(long)


def test_score_is_the_linear_model(spark):
    docs = [(i, f"{'bad vile words here' if i % 3 == 0 else 'kind calm words there'} {i}") for i in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = train(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"))
    assert (model.weight != 0).sum() > 10
    for r in score(df, model).collect():
        z = model.bias + sum(float(model.weight[f]) for f in brute(r["text"]))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6)
    less = train(df, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int"), max_entries=300)
    assert less.weight.any() and not np.array_equal(less.weight, model.weight)


def test_ranking_of_held_out_rows(spark, data):
    at = data.replace("sf0.001", "sf0.01")
    rows = queries.op9_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    assert y.sum() > 10 and auc > 0.8 and (s[y == 1] >= 0.7).mean() > 0.7 and (s[y == 0] < 0.7).mean() > 0.95
