import io
import json
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions.text import cluster_label, comment_confidence, first_cue, has_verb, intent, strings
from tessella.functions.words import INPUT_VERBS, SEQUENTIAL_CUES
from tessella.operators import cluster, commands, compare, constraints, dependency, refine, terms, vectors
from tessella.sources import export
from tessella.sources.files import read_csv_folder, read_requirements
from tessella.sources.providers import mock_expand, parse_reply
from tessella.tables import Store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_delimited_file(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'Req_ID,Description,Module\nA,"one, two",m\nB,x,y,z\nC,short\nNA,caf\xe9,\n')
    got = read_requirements(spark, str(tmp_path / "r.csv"))
    assert [tuple(r) for r in got.orderBy("pos").collect()] == [("A", "one, two", "m", 0), ("C", "short", None, 1), (None, "café", None, 2)]
    again = read_csv_folder(spark, str(tmp_path / "r.csv"), ["Req_ID", "Description", "Module"])
    assert sorted(r["Req_ID"] or "" for r in again.collect()) == ["", "A", "C"]


def test_workbook(spark, tmp_path):
    z = zipfile.ZipFile(tmp_path / "r.xlsx", "w")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>text</t></si><si><r><t>a </t></r><r><t>b</t></r></si></sst>")
    z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>id</t></is></c><c r="B1" t="s"><v>0</v></c></row><row><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    z.close()
    assert [tuple(r) for r in read_requirements(spark, str(tmp_path / "r.xlsx")).collect()] == [(None, "a b", 0)]


def test_cues_and_labels(spark):
    t = spark.createDataFrame([("Wait until it is before dawn", "useful"), ("nothing", None)], "a string, b string")
    got = t.select(first_cue("a", SEQUENTIAL_CUES).alias("c"), has_verb("b", INPUT_VERBS).alias("v")).collect()
    assert got[0]["c"] == "before" and got[0]["v"] and got[1]["c"] is None
    one = t.limit(1)
    assert one.select(cluster_label(strings(["degrees celsius", "celsius"])).alias("x")).first()["x"] == "Degrees Celsius"
    assert one.select(cluster_label(strings([])).alias("x")).first()["x"] == "Uncategorized"
    assert one.select(comment_confidence(F.lit("moves the torque command"), F.lit("Torque"), strings(["torque command"])).alias("x")).first()["x"] == 0.9
    assert one.select(intent(F.lit("The system shall do it.")).alias("x")).first()["x"] == "do it"


def blobs(spark, extra=()):
    rng = np.random.default_rng(7)
    pts = np.concatenate([rng.normal(c, 0.05, (30, 8)) for c in np.eye(8)[:3] * 4] + [rng.uniform(-30, 30, (5, 8))])
    return spark.createDataFrame([(i, p.tolist(), i // 30 if i < 90 else -1) for i, p in enumerate([*pts, *extra])], "idx long, embedding array<double>, label int")


def test_density_clusters(spark):
    b = blobs(spark)
    got = {r["idx"]: r["label"] for r in cluster.hdbscan(b.drop("label"), min_cluster_size=10).collect()}
    assert [len({got[i] for i in range(k * 30, k * 30 + 30)} - {-1}) for k in range(3)] == [1, 1, 1]
    assert len(set(got.values()) - {-1}) == 3 and sum(v == -1 for v in got.values()) >= 3


def test_silhouette_brute_force(spark):
    b = blobs(spark)
    p = {r["idx"]: (np.array(r["embedding"]), r["label"]) for r in b.where("label <> -1").collect()}
    s = []
    for i, (x, c) in p.items():
        d = {k: np.mean([np.linalg.norm(x - y) for j, (y, e) in p.items() if e == k and j != i]) for k in range(3)}
        low = min(v for k, v in d.items() if k != c)
        s.append((low - d[c]) / max(low, d[c]))
    assert vectors.silhouette(b).first()[0] == pytest.approx(np.mean(s), abs=1e-6)


def test_ties_and_edges(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0], 0) for i in range(4)] + [(4, [0.0, 0.0], -1)], "idx long, embedding array<double>, label int")
    assert rows(vectors.representatives(same, 2), "idx") == [(2,), (3,)]
    assert [(r["i"], r["j"]) for r in vectors.neighbours(same, 1).orderBy("i").collect()][:2] == [(0, 1), (1, 0)]
    assert vectors.neighbours(same, 1, ties="high").where("i = 0").first()["j"] == 3
    assert vectors.similarity_graph(same, 0.9, max_edges=3).count() == 3
    assert compare.delta_report(same, same).first()["mean_delta"] in (0.0, 0.2)
    empty = same.where("idx < 0")
    assert vectors.similarity_edges(empty, 0.5).count() == 0 and vectors.coherence(empty).count() == 0


def test_bimodal(spark):
    rng = np.random.default_rng(3)
    two = [(i, (rng.normal(0, 0.1, 4) + (i % 2) * 3).tolist(), 0) for i in range(30)]
    one = [(100 + i, rng.normal(0, 0.1, 4).tolist(), 1) for i in range(30)]
    got = {r["label"]: r for r in refine.bimodality(spark.createDataFrame(two + one, "idx long, embedding array<double>, label int")).collect()}
    assert got[0]["score"] > 0.5 and len(set(got[0]["sub_labels"][::2])) == 1 and got[0]["sub_labels"][0] != got[0]["sub_labels"][1]
    assert got[1]["score"] < got[0]["score"]


@pytest.mark.parametrize("limit", [1000, 3])
def test_components(spark, limit):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, 300), (401, 400)]
    least = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    got = constraints.components(spark.createDataFrame(pairs, "a long, b long"), limit=limit).collect()
    assert len(got) == len(least) and {r["node"]: r["component"] for r in got} == least


def test_constraints(spark):
    k = spark.createDataFrame([(1, 2, "must-link", 1), (2, 3, "must-link", 2), (3, 1, "cannot-link", 3)], "a long, b long, type string, feedback_id long")
    assert rows(constraints.conflicts(k), "a", "b", "component") == [(1, 3, 1)]
    points = spark.createDataFrame([(i, c, 1.0 - i / 10, [float(c), 1.0]) for i, c in enumerate([0, 0, 1, 1, 2])], "idx long, label int, prob double, embedding array<double>")
    must = spark.createDataFrame([(0, 2, "must-link", 1)], k.schema)
    assert rows(constraints.apply_must_link(points, must), "idx", "label")[:3] == [(0, 0), (1, 0), (2, 0)]
    cannot = spark.createDataFrame([(0, 1, "cannot-link", 1)], k.schema)
    got = dict(rows(constraints.repair_cannot_link(points, cannot), "idx", "label"))
    assert got[0] == 0 and got[1] != 0


def _one_by_one(rows, pairs):
    """The cannot-link pairs in turn, with plain sums."""
    label, prob, v = ({r[0]: r[k] for r in rows} for k in (1, 2, 3))
    total, count = {}, {}
    for i in label:
        if label[i] != -1:
            total[label[i]] = total.get(label[i], 0) + np.array(v[i])
            count[label[i]] = count.get(label[i], 0) + 1
    for a, b, _, _ in sorted(pairs, key=lambda p: (p[3], p[0], p[1])):
        if a not in label or b not in label or label[a] == -1 or label[a] != label[b]:
            continue
        m = a if prob[a] < prob[b] else b
        near = [(-float(np.dot(v[m], total[c] / np.linalg.norm(total[c]))), c) for c in total if c != label[m] and count[c]]
        new = min(near)[1] if near else max(total) + 1
        total[label[m]] = total[label[m]] - np.array(v[m])
        count[label[m]] -= 1
        total[new], count[new] = total.get(new, 0) + np.array(v[m]), count.get(new, 0) + 1
        label[m] = new
    return label


@pytest.mark.parametrize(("seed", "groups", "n"), [(1, 4, 60), (2, 1, 6)])
def test_cannot_link_like_one_by_one(spark, seed, groups, n):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(groups)) if i % 11 else (-1 if groups > 1 else 0), float(rng.integers(100)) / 100, rng.normal(size=3).tolist()) for i in range(n)]
    pairs = [(int(a), int(b), "cannot-link", int(rng.integers(1000))) for a, b in rng.integers(0, n + 2, (n, 2)) if a != b]
    points = spark.createDataFrame(rows, "idx long, label int, prob double, embedding array<double>")
    got = {r["idx"]: r["label"] for r in constraints.repair_cannot_link(points, spark.createDataFrame(pairs, "a long, b long, type string, feedback_id long")).collect()}
    want = _one_by_one(rows, pairs)
    assert got == want and any(want[r[0]] != r[1] for r in rows)


def test_dependency_rules(spark):
    t = spark.createDataFrame([(0, "REQ-001", "Generate a temperature reading", 0, [1.0, 0.0]), (1, "REQ-002", "Use the temperature reading as defined in REQ-001", 0, [1.0, 0.05])], "idx long, req_id string, text string, label int, embedding array<double>")
    nodes, edges = dependency.dependency_tree(t)
    e = edges.collect()
    assert [(r["source"], r["target"], r["relation"], r["weight"]) for r in e] == [(0, 1, "hierarchical", 0.95)]
    assert rows(nodes, "idx", "level") == [(0, 0), (1, 1)]
    cycle = spark.createDataFrame([(0, 1, "data", 0.9, 2, 0, 1, 1), (1, 2, "data", 0.8, 2, 1, 1, 1), (2, 0, "data", 0.5, 2, 2, 1, 1)], "source long, target long, relation string, weight double, phase int, i long, rank int, rule int")
    assert rows(dependency.break_cycles(cycle), "source", "target") == [(0, 1), (1, 2)]


def test_replies(spark):
    good = '{"expanded_text":"x y","domain_terms":["A","a"],"confidence":1.7}'
    t = spark.createDataFrame([(good,), ("```" + good,), ("[1]",), ('{"domain_terms":[]}',), (None,)], "r string")
    got = [r["p"] for r in t.select(parse_reply(F.col("r")).alias("p")).collect()]
    assert got[0]["confidence"] == 1.0 and got[0]["domain_terms"] == ["a"] and got[1:] == [None] * 4
    x = mock_expand(spark.createDataFrame([("The system shall log Telemetry.",), ("",)], "text string")).collect()
    assert x[0]["functional_intent"] == "log Telemetry" and x[1]["expanded_text"] is None


def test_exports_are_well_formed(spark):
    r = spark.createDataFrame([(1, "R<1>", "a & b", "m", "s", 0, 0.5), (2, "R2", 'q"', "m", "s", -1, None), (3, "R3", "t", "m", "s", None, None)], "id long, req_id string, text string, module string, section string, cluster_id int, membership_prob double")
    c = spark.createDataFrame([(0, "Group & co", 1)], "cluster_id int, label string, size int")
    e = spark.createDataFrame([(1, 2, "data", 0.9)], "source_id long, target_id long, relation string, weight double")
    x = ElementTree.fromstring(export.reqif("s & t", r, c, "2000-01-01T00:00:00Z").first()[0])
    assert sum(1 for n in x.iter() if n.tag.endswith("SPEC-OBJECT")) == 4
    y = ElementTree.fromstring(export.xmi("s", r, c, e).first()[0])
    kinds = [n.get("{http://www.omg.org/spec/XMI/20131001}type") for n in y.iter("packagedElement")]
    assert (kinds.count("uml:Package"), kinds.count("uml:Class"), kinds.count("uml:Dependency")) == (2, 3, 1)
    assert [v["cluster_label"] for v in export.csv_rows(r, c).orderBy("text").collect()] == ["Group & co", "Noise", ""]


def test_documents_are_written_in_parts(spark, tmp_path):
    r = spark.range(500).select("id", F.concat(F.lit("R<&>"), F.col("id").cast("string")).alias("req_id"), F.lit('line\none "two"\t').alias("text"), F.lit("m").alias("module"), F.lit("").alias("section"), (F.col("id") % 5 - 1).cast("int").alias("cluster_id"), F.lit(0.5).alias("membership_prob"))
    c = spark.createDataFrame([(i, f"G {i}", 100) for i in range(4)], "cluster_id int, label string, size int")
    e = spark.createDataFrame([(i, i + 1, "data", 0.5) for i in range(0, 90, 3)], "source_id long, target_id long, relation string, weight double")
    export.write_document(export.reqif_fragments("s", r, c, "2000"), str(tmp_path / "a.reqif"))
    x = ElementTree.parse(tmp_path / "a.reqif").getroot()
    tag = lambda n: n.tag.rsplit("}", 1)[-1]
    assert sum(tag(n) == "SPEC-OBJECT" for n in x.iter()) == 504 and sum(tag(n) == "SPEC-HIERARCHY" for n in x.iter()) == 504
    texts = [n.get("THE-VALUE") for n in x.iter() if tag(n) == "ATTRIBUTE-VALUE-STRING"]
    assert texts[4:6] == ["R<&>0", 'line\none "two"\t'] and texts[-2] == "R<&>499"
    export.write_document(export.xmi_fragments("s", r, c, e), str(tmp_path / "b.xmi"))
    y = ElementTree.parse(tmp_path / "b.xmi").getroot()
    assert [len(p) for p in y[0] if p.get("{http://www.omg.org/spec/XMI/20131001}type") == "uml:Package"] == [100] * 5 and len(y[0]) == 5 + 30
    export.write_document(export.bundle_fragments('s "q"', r, c, e), str(tmp_path / "c.json"))
    z = json.loads((tmp_path / "c.json").read_text())
    assert z["meta"] == {"session": 's "q"', "items": 504, "relationships": 30} and [i["id"] for i in z["items"]] == [*range(4), *range(500)] and len(z["relationships"]) == 30
    none = e.where("false")
    export.write_document(export.bundle_fragments("s", r.where("false"), c.where("false"), none), str(tmp_path / "d.json"))
    assert json.loads((tmp_path / "d.json").read_text())["items"] == [] and not list(tmp_path.glob("*.parts"))


def test_store_upsert_and_moves(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    row = "id long, session_id long, cluster_id int, label string, keywords array<string>, size int"
    store.append("clusters", spark.createDataFrame([(1, 1, 0, "a", [], 2), (2, 2, 0, "b", [], 1)], row))
    store.upsert("clusters", spark.createDataFrame([(1, 1, 0, "z", [], 3), (3, 1, 1, "n", [], 1)], row), ["session_id", "cluster_id"])
    assert rows(store.read("clusters"), "session_id", "cluster_id", "label") == [(1, 0, "z"), (1, 1, "n"), (2, 0, "b")]
    r = spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "id long, cluster_id int")
    moved, sizes = commands.submit_feedback(r, store.read("clusters", 1), spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "id long, requirement_id long, new_cluster_id int"))
    assert rows(moved, "id", "cluster_id") == [(1, 0), (2, 1), (3, 1)] and rows(sizes, "cluster_id", "size") == [(0, 2), (1, 3)]
    done, refused = commands.decide(spark.createDataFrame([(1, "pending"), (2, "applied")], "id long, status string"), spark.createDataFrame([(1, "accept"), (2, "reject"), (9, "accept")], "id long, action string"))
    assert rows(done, "id", "status") == [(1, "applied"), (2, "applied")] and rows(refused, "id", "status") == [(2, "applied"), (9, "unknown")]


def test_quality_warnings(spark):
    t = spark.createDataFrame([(1, "The unit may log data.", "The unit shall log data within 10 ms and more.", 0.8)], "idx long, original string, enriched string, confidence double").withColumn("domain_terms", F.array())
    r = terms.expansion_quality(t).first()
    assert r["invented_numbers"] == ["10ms"] or "10" in "".join(r["invented_numbers"]) and r["changed_obligation"]


def test_stream_ingest(spark, tmp_path):
    from tessella.streaming.ingest import ingest_stream

    spark.sql("SELECT timestamp '2024-01-01 00:00:00' AS ts, explode(array('abcdef', 'abcdef', 'x', '<b>ghijkl</b>')) AS text").write.parquet(str(tmp_path / "in"))
    s = ingest_stream(spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("ingested").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("ingested"), "text") == [("abcdef",), ("ghijkl",)]


def test_vocabulary_by_numbers(spark, monkeypatch):
    texts = ["The motor shall stop the motor", None, "", "motor stop İ K-9 x2 motor", "stop", "ﬁne Ångström-units and motor stop", "a b c the"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = {}
    for t in texts:
        w = terms._tokens(t, True)
        for n in (1, 2, 3):
            own = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
            for g in own:
                want.setdefault(g, [n, 0, 0])[1] += 1
            for g in set(own):
                want[g][2] += 1
    got = {r["term"]: [r["ngram_size"], r["term_frequency"], r["document_frequency"]] for r in terms.ngram_counts(df).collect()}
    assert got == want
    docs = sum(bool(terms._tokens(t, True)) for t in texts)
    score = {g: round((1 + np.log(tf)) * (1 + np.log((docs + 1) / (d + 1))), 6) for g, (_, tf, d) in want.items()}
    order = sorted(want, key=lambda g: (-score[g], -want[g][2], -want[g][1], g))
    for n in (3, 7, 400):  # ties at the end go by the alphabet
        assert [r["term"] for r in terms.vocabulary(df, top_n=n).collect()] == order[:n]
    assert terms.vocabulary(df.where("text = ''")).count() == 0
    assert terms._tokens("x-ray RAY-2 ünï", False) == ["x-ray", "ray-2"] or terms._tokens("x-ray", False) == ["x-ray"]


def _mean_silhouette(x, label):
    out = []
    for i in range(len(x)):
        d = np.linalg.norm(x - x[i], axis=1)
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[own].mean(), min(d[label == c].mean() for c in set(label) - {label[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_what_if_silhouettes(spark):
    rng = np.random.default_rng(12)
    centre = np.array([[0, 0, 0], [2, 0, 0], [2.5, 1, 0], [0, 6, 0], [6, 6, 1]])
    label = np.array([i % 5 for i in range(90)] + [5])
    x = np.concatenate([centre[label[:90]] + rng.normal(size=(90, 3)) / 2 + np.where((np.arange(90) % 10 >= 5) & (label[:90] == 3), 3, 0)[:, None] * np.array([0, 0, 1]), [[9, 9, 9]]])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))] + [(200, [0.0] * 3, -1)], "idx long, embedding array<double>, label int")
    before = _mean_silhouette(x, label)
    pairs = [(a, b) for a in range(6) for b in range(a + 1, 6)]
    got = {(r["a"], r["b"]): r for r in refine.merge_deltas(df, spark.createDataFrame(pairs, "a int, b int")).collect()}
    for a, b in pairs:
        assert got[a, b]["before"] == pytest.approx(before, abs=1e-9) and got[a, b]["after"] == pytest.approx(_mean_silhouette(x, np.where(label == b, a, label)), abs=1e-9)
    two = df.where("label IN (0, 3)")
    assert refine.merge_deltas(two, spark.createDataFrame([(0, 3)], "a int, b int")).first()["delta"] == 0.0  # one cluster has no silhouette
    splits = refine.suggest_splits(df, min_spread=0.0).collect()
    sides = {(r["label"], r["idx"]): r["side"] for r in refine.split_sides(df, min_spread=0.0).collect()}
    assert splits and [r["rank"] for r in splits] == list(range(1, len(splits) + 1))
    for r in splits:
        after = np.array([100 if c == r["label"] and sides[c, i] else c for i, c in enumerate(label.tolist())])
        assert r["after"] == pytest.approx(_mean_silhouette(x, after), abs=1e-9) and (r["first"], r["second"]) == ((after == r["label"]).sum(), (after == 100).sum())
