"""Expansion providers: a deterministic one, and an HTTP client for chat-completion servers."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import components, dedupe_fold, domain_terms, intent, ngrams, plain_text, strings, vocabulary_tokens
from ..lineage import cut, folder

#: Characters of a requirement that a prompt holds.
MAX_TEXT = 12_000
MAX_REPLY = 64_000
_REPLY = "expanded_text string, domain_terms array<string>, functional_intent string, mentioned_components array<string>, assumptions array<string>, confidence double, warnings array<string>"


class Provider(Protocol):
    name: str
    model: str

    def complete(self, prompt: str) -> str: ...


class HttpProvider:
    """A server that answers POST .../chat/completions; up to `retries` (0 to 5) further tries, each after 0.25 s more, 1 s at most."""

    name = "http"

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 30.0, retries: int = 2):
        self.url, self.model, self.key, self.timeout, self.retries = url.rstrip("/"), model, key, timeout, min(max(retries, 0), 5)

    def complete(self, prompt: str) -> str:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}).encode()
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {})}
        for n in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.url}/chat/completions", body, head), timeout=self.timeout) as r:
                    return json.loads(r.read(4 * MAX_REPLY))["choices"][0]["message"]["content"]
            except (urllib.error.URLError, TimeoutError, KeyError, IndexError, ValueError):
                if n == self.retries:
                    raise
                time.sleep(min(0.25 * (n + 1), 1.0))
        raise AssertionError


def prompt(text: Column, terms: Column) -> Column:
    return F.concat_ws("\n", F.lit("Expand the requirement below without adding facts. Answer with one JSON object with the keys expanded_text, domain_terms, functional_intent, mentioned_components, assumptions, confidence, warnings."), F.concat(F.lit("Domain terms: "), F.array_join(terms, ", ")), F.concat(F.lit("Requirement: "), text))


def parse_reply(reply: Column) -> Column:
    """The reply as a struct, or null if it is not one plain JSON object with the needed keys: fences, arrays and replies over 64 000 characters are refused, confidence is clamped to 0..1, lists are bounded."""
    t = F.trim(reply)
    parsed = F.from_json(t, _REPLY)
    ok = (F.length(t) <= MAX_REPLY) & t.startswith("{") & t.endswith("}") & (F.trim(F.coalesce(parsed["expanded_text"], F.lit(""))) != "") & parsed["confidence"].isNotNull()
    return F.when(ok, F.struct(
        plain_text(parsed["expanded_text"], 12_000, normal=False).alias("expanded_text"), domain_terms(F.coalesce(parsed["domain_terms"], strings([]))).alias("domain_terms"),
        F.coalesce(parsed["functional_intent"], F.lit("")).alias("functional_intent"), dedupe_fold(F.coalesce(parsed["mentioned_components"], strings([])), 50).alias("mentioned_components"),
        dedupe_fold(F.coalesce(parsed["assumptions"], strings([])), 20).alias("assumptions"), F.least(F.greatest(parsed["confidence"], F.lit(0.0)), F.lit(1.0)).alias("confidence"), dedupe_fold(F.coalesce(parsed["warnings"], strings([])), 30).alias("warnings")))


def local_terms(text: Column, top_n: int = 12) -> Column:
    """The text's own vocabulary: within one text every score is (1 + ln tf), so terms rank by count, then by name."""
    grams = F.flatten(F.array(*[ngrams(vocabulary_tokens(text, normal=False), n) for n in (1, 2, 3)]))
    counted = F.transform(F.array_distinct(grams), lambda g: F.struct((-F.size(F.filter(grams, lambda x: x == g))).alias("n"), g.alias("g")))
    return F.slice(F.transform(F.array_sort(counted), lambda s: s["g"]), 1, top_n)


def mock_expand(df: DataFrame, text: str = "text", vocabulary: list[str] | None = None) -> DataFrame:
    """df with the deterministic expansion: expanded_text, domain_terms, functional_intent, mentioned_components, confidence 0.85. All of it is column expressions."""
    t = df.withColumn("__t", plain_text(text)).withColumn("__local", local_terms(F.col("__t")))
    supplied = F.filter(domain_terms(strings(vocabulary or [])), lambda x: F.contains(F.lower(F.col("__t")), x))
    t = t.withColumn("domain_terms", dedupe_fold(F.concat(supplied, "__local"), 50)).withColumns({"mentioned_components": components("__t", "domain_terms"), "functional_intent": intent("__t")})
    parts = F.array_compact(F.array(
        F.concat(F.lit("Original requirement: "), "__t"), F.when((F.col("functional_intent") != "") & (F.col("functional_intent") != F.col("__t")), F.concat(F.lit("Functional intent: "), "functional_intent", F.lit("."))),
        F.when(F.size("mentioned_components") > 0, F.concat(F.lit("Explicitly mentioned components: "), F.array_join("mentioned_components", ", "), F.lit("."))),
        F.when(F.size("domain_terms") > 0, F.concat(F.lit("Domain vocabulary from the requirement: "), F.array_join(F.slice("domain_terms", 1, 12), ", "), F.lit(".")))))
    return t.withColumn("expanded_text", F.when(F.col("__t") != "", F.array_join(parts, " "))).withColumn("confidence", F.lit(0.85)).drop("__t", "__local")


class RequestLog:
    """Replies by the hash of their request, a file each, in a folder that all executors share. A reply is there whole or not at all; errors are kept for one run only."""

    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def _at(self, name: str):
        from pyarrow import fs

        if "://" in self.root or self.root.startswith("file:"):
            system, path = fs.FileSystem.from_uri(self.root.replace("file:/", "file:///") if self.root.startswith("file:/") and not self.root.startswith("file:///") else self.root)
        else:
            system, path = fs.LocalFileSystem(), self.root
        return system, f"{path}/{name}"

    def _exists(self, name: str) -> bool:
        from pyarrow import fs

        system, path = self._at(name)
        return system.get_file_info(path).type == fs.FileType.File

    def _write(self, name: str, text: str) -> None:
        system, path = self._at(name)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        aside = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as out:
            out.write(text.encode())
        system.move(aside, path)

    def _read(self, name: str) -> str | None:
        system, path = self._at(name)
        if not self._exists(name):
            return None
        with system.open_input_stream(path) as f:
            return f.read().decode()

    def ask(self, key: str, question: str, provider: Provider, fail_fast: bool) -> tuple[str | None, str | None]:
        """The reply and the error to a request; the provider is asked only if neither is known, and not after a failure that stops the run."""
        name = f"{key[:2]}/{key}"
        reply, error = self._read(name), self._read(f"{name}.{self.run}")
        if reply is not None or error is not None:
            return reply, error
        if fail_fast and self._exists(f"_stopped.{self.run}"):
            return None, STOPPED
        try:
            reply = provider.complete(question)
        except Exception as e:  # noqa: BLE001 a failed request is a record
            error = f"{type(e).__name__}: {e}"[:500]
            self._write(f"{name}.{self.run}", error)
            if fail_fast:
                self._write(f"_stopped.{self.run}", error)
            return None, error
        self._write(name, reply)
        return reply, None


#: The error of requests that were not sent because another one had failed.
STOPPED = "stopped after a failed request"


def enrich(df: DataFrame, provider: Provider, text: str = "text", vocabulary: list[str] | None = None, log: str | None = None, concurrency: int = 4, fail_fast: bool = False) -> DataFrame:
    """df with reply fields from a provider, written once; a failed call or an unusable reply is status 'failed' with its message.

    Equal requests are one. Replies go to a log (a folder that all executors share) as they come, which a task reads
    before it asks, so that neither a second action nor a task that runs
    again asks twice; a log from an earlier run serves too. A task has up to concurrency (1 to 16) requests under way.
    With fail_fast the first failure keeps all tasks from asking further,
    and raises when they have ended. Texts that are blank are not asked.
    """
    spark = df.sparkSession
    kept = RequestLog(log or folder(spark, "requests"), uuid.uuid4().hex)
    key = F.sha2(F.concat_ws("\n", F.lit(provider.name), F.lit(provider.model), "__p"), 256)
    plain = F.col("__t")
    asked = df.withColumn("__t", plain_text(text, MAX_TEXT)).withColumn("__p", F.when(plain != "", prompt(plain, strings(vocabulary) if vocabulary is not None else local_terms(plain)))).withColumn("__k", F.when(F.col("__p").isNotNull(), key))
    asked = cut(asked)

    def call(batches):
        with ThreadPoolExecutor(min(max(concurrency, 1), 16)) as pool:
            for b in batches:
                both = list(pool.map(lambda kp: kept.ask(*kp, provider, fail_fast), zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r for r, _ in both], pa.string()), pa.array([e for _, e in both], pa.string())], ["__k", "__reply", "__error"])

    answers = cut(asked.where("__k IS NOT NULL").groupBy("__k").agg(F.first("__p").alias("__p")).mapInArrow(call, "__k string, __reply string, __error string"))
    if fail_fast and (bad := answers.where(F.col("__error").isNotNull() & (F.col("__error") != STOPPED)).select("__error").first()):
        raise RuntimeError(bad["__error"])
    got = asked.join(answers, "__k", "left").withColumn("__x", parse_reply(F.col("__reply")))
    status = F.when(F.col("__x").isNotNull(), "succeeded").otherwise("failed")
    message = F.when(F.col("__k").isNull(), "Requirement text is empty.").otherwise(F.coalesce("__error", F.lit("reply could not be used")))
    return got.select(*df.columns, "__x.*", status.alias("status"), F.when(status == "failed", message).alias("error_message"))


def enrich_missing(requirements: DataFrame, stored: DataFrame, provider: Provider, prompt_version: str, force: bool = False, lists: tuple[str, ...] = (), objects: tuple[str, ...] = ("quality_report",), **asking) -> tuple[DataFrame, DataFrame]:
    """(reused, made): stored results that still hold for requirements(id, text), and new rows for the others alone (for all, if force), keyed as stored ones are.

    A stored row holds for the plain text's hash, this provider and prompt,
    with well-formed JSON in the columns named. Prompts have the vocabulary
    of all the requirements, 50 terms. New rows are written once.
    """
    from ..operators.reads import plain_hash, valid_enrichments
    from ..operators.terms import vocabulary

    reused = valid_enrichments(stored, requirements, prompt_version, provider.name, provider.model, lists, tuple(c for c in objects if c in stored.columns))
    reused = reused.where("false") if force else reused
    missing = requirements.join(reused.select(F.col("requirement_db_id").alias("id")), "id", "left_anti")
    words = [r["term"] for r in vocabulary(requirements.withColumn("__t", plain_text("text", MAX_TEXT)), "__t", 50).collect()]  # 50 at most
    made = enrich(missing.select("id", "text"), provider, vocabulary=words, **asking)
    keyed = made.withColumns({"requirement_db_id": F.col("id"), "requirement_text_hash": plain_hash("text"), "provider": F.lit(provider.name), "model": F.lit(provider.model), "prompt_version": F.lit(prompt_version)})
    return reused, cut(keyed.drop("id", "text"))
