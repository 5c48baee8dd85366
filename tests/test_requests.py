"""Requests to a provider are sent once, whatever reads the result or runs again."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tessella.operators import commands, session
from tessella.snapshots import Snapshots
from tessella.sources.providers import HttpProvider, enrich


@pytest.fixture
def server():
    """A chat server that counts what it is asked by requirement; 'refuse' fails, 'odd' answers no JSON."""
    asked, lock, together = Counter(), threading.Lock(), [0, 0]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            text = prompt.rsplit("Requirement: ", 1)[1]
            with lock:
                asked[text] += 1
                together[0] += 1
                together[1] = max(together)
            threading.Event().wait(0.02)
            with lock:
                together[0] -= 1
            if "refuse" in text:
                self.send_error(500)
                return
            reply = "no" if "odd" in text else json.dumps({"expanded_text": f"{text} More.", "domain_terms": ["Cell"], "functional_intent": "", "mentioned_components": [], "assumptions": [], "confidence": 0.5, "warnings": []})
            body = json.dumps({"choices": [{"message": {"content": reply}}]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.asked, s.together = asked, together
    yield s
    s.shutdown()


def provider(s):
    return HttpProvider(f"http://127.0.0.1:{s.server_port}", "m", retries=0)


def test_once_per_text(spark, server, tmp_path):
    texts = [f"text {i % 12}" for i in range(40)] + ["odd one", "refuse me", "", None, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = enrich(df, provider(server), log=str(tmp_path / "log"), concurrency=3)
    got = {r["id"]: r for r in out.collect()}
    assert out.where("status = 'succeeded'").count() == 40 and out.count() == 45  # a second and third action
    assert set(server.asked.values()) == {1} and len(server.asked) == 14 and server.together[1] <= 3 * 4
    assert got[40]["error_message"] == "reply could not be used" and "500" in got[41]["error_message"] and {got[i]["error_message"] for i in (42, 43, 44)} == {"Requirement text is empty."}
    # another run with the same log asks only for what failed
    enrich(df, provider(server), log=str(tmp_path / "log")).count()
    assert server.asked["refuse me"] == 2 and sum(server.asked.values()) == 15


def test_a_run_that_broke_off(spark, server, tmp_path):
    df = spark.createDataFrame([(i, f"row {i}") for i in range(30)], "id long, text string")

    class Dying(HttpProvider):
        def complete(self, prompt):
            if prompt.endswith("row 17"):
                import os

                os._exit(1)  # the worker is gone, with what it held
            return super().complete(prompt)

    with pytest.raises(Exception, match="(?i)worker|crashed|exited|EOF"):
        enrich(df.coalesce(1), Dying(provider(server).url, "m", retries=0), log=str(tmp_path / "log"), concurrency=1).count()
    before = sum(server.asked.values())
    assert enrich(df, provider(server), log=str(tmp_path / "log")).where("status = 'succeeded'").count() == 30
    assert before > 0 and sum(server.asked.values()) <= 31 and len(server.asked) == 30


def test_fail_fast_stops(spark, server, tmp_path):
    df = spark.createDataFrame([(0, "refuse at once")] + [(i, f"row {i}") for i in range(1, 200)], "id long, text string").coalesce(1)
    with pytest.raises(RuntimeError, match="500"):
        enrich(df, provider(server), log=str(tmp_path / "log"), concurrency=1, fail_fast=True)
    assert server.asked["refuse at once"] == 1 and sum(server.asked.values()) < 200


def test_session_enrichment(spark, server, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(i, f"R{i}", t, "", "") for i, t in enumerate(["cell one", "cell two", "cell two", "refuse it"])], "id long, req_id string, text string, module string, section string")
    session.create(store, 1, rows)
    one = session.enrich_session(store, 1, provider(server), "v1")
    found = one.read("enriched_requirements")
    status = lambda now: commands.enrichment_status(rows, now.read("enriched_requirements").withColumn("requirement_id", F.col("requirement_db_id"))).first()
    assert sorted((r["requirement_db_id"], r["status"]) for r in found.collect()) == [(0, "succeeded"), (1, "succeeded"), (2, "succeeded"), (3, "failed")]
    assert json.loads(found.where("id = 1").first()["quality_report"])["status"] == "succeeded" and status(one)["status"] == "partial"
    n = sum(server.asked.values())
    two = session.enrich_session(store, 1, provider(server), "v1")
    assert server.asked["refuse it"] == 2 and sum(server.asked.values()) == n + 1  # what holds is not asked again
    assert two.read("enriched_requirements").count() == 4
    session.enrich_session(store, 1, provider(server), "v1", force=True)
    assert server.asked["cell one"] == 2
    changed = store.open(1)
    changed.commit(requirements=changed.read("requirements").withColumn("text", F.when(F.col("id") == 0, "cell new").otherwise(F.col("text"))))
    session.enrich_session(store, 1, provider(server), "v1")
    assert server.asked["cell new"] == 1 and server.asked["cell two"] == 2
