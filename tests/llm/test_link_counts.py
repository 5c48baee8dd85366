"""n_links of the near-duplicate join against brute force."""

import numpy as np

from tessella.llm import ngram_join as m


def test_links_are_exact(spark, monkeypatch):
    monkeypatch.setattr(m, "_BLOCK", 8)
    rng = np.random.default_rng(4)
    docs = []
    for g, n in enumerate((40, 6, 1)):
        base = [f"g{g}w{x}" for x in range(60)]
        for i in range(n):
            words = list(base)
            words[int(rng.integers(0, 60))] = f"new{g}x{i}"
            docs.append((len(docs), " ".join(words)))
    docs += [(len(docs), docs[3][1]), (len(docs) + 1, "")]
    sets = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in docs}
    reps = {d: min(e for e in sets if sets[e] == s) if s else d for d, s in sets.items()}
    num, den = 8, 10
    want = {}
    for d in sets:
        r = reps[d]
        want[d] = sum(1 for e in set(reps.values()) if e != r and sets[r] & sets[e] and den * len(sets[r] & sets[e]) >= num * len(sets[r] | sets[e]))
    got = {r["doc_id"]: r["n_links"] for r in m.ngram_join(spark.createDataFrame(docs, "doc_id long, text string"), 3, (num, den)).collect()}
    assert got == want and max(want.values()) > 20
