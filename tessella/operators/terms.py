"""Vocabulary, cluster keywords and quality of expanded texts."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.text import clamp, cluster_label, domain_terms, label_tokens, meaning_tokens, ngrams, numbers, quality_tokens, strings
from ..lineage import cut, spread


#: Words that one task counts n-grams of at a time.
_AT_ONCE = 1 << 20


def _tokens(text: str | None, normal: bool) -> list[str]:
    """The words of a text that vocabulary_tokens() finds."""
    t = text or ""
    if normal and not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return [w for w in _WORD.findall(t.lower()) if w not in _STOP]


_WORD, _STOP = re.compile(W.VOCABULARY_TOKEN), frozenset(W.REQUIREMENT_STOPWORDS)


def _numbers(words: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit number of each word, the same in every task."""
    return pd.util.hash_array(words.astype(object), hash_key=f"{salt:016d}", categorize=False).view(np.int64)


def _texts(df: DataFrame, text: str, normal: bool, work, schema: str) -> DataFrame:
    """work(tokens of all texts, number of tokens of each) for runs of texts."""

    def go(batches):
        flat, many = [], []
        for b in batches:
            for t in b.column(0).to_pylist():
                own = _tokens(t, normal)
                flat += own
                many.append(len(own))
                if len(flat) >= _AT_ONCE:
                    yield work(flat, many)
                    flat, many = [], []
        if many:
            yield work(flat, many)

    return spread(df.select(F.col(text).alias("t"))).mapInArrow(go, schema)


def numbered_words(df: DataFrame, text: str, normal: bool, salt: int = 0) -> DataFrame:
    """(word, number) of all words."""

    def work(flat, many):
        words = pd.unique(np.array(flat, dtype=object))
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "number": pa.array(_numbers(words, salt))})

    return _texts(df, text, normal, work, "word string, number long").distinct()


def gram_counts(df: DataFrame, text: str = "text", normal: bool = True, salt: int = 0) -> DataFrame:
    """(size, a, b, c, term_frequency, document_frequency) of 1- to 3-grams by the numbers of their words, 0 beyond size; the row of size 0 has the number of texts with a word as both frequencies. Runs of texts are counted before anything is shuffled."""

    def work(flat, many):
        code, names = pd.factorize(np.array(flat, dtype=object))
        number = np.append(_numbers(names, salt) if len(names) else np.zeros(0, np.int64), 0)
        doc, wide = np.repeat(np.arange(len(many)), many), len(names) + 1
        out = [np.array([[0], [0], [0], [0], [n], [n]]) for n in [sum(1 for m in many if m)]]
        code = code.astype(np.int64) + 1
        for size in (1, 2, 3):
            n = max(0, len(code) - size + 1)
            use = np.flatnonzero(doc[:n] == doc[size - 1 : size - 1 + n])
            parts = [code[k : k + n][use] for k in range(size)]
            if wide**size < 1 << 62:
                key = parts[0].copy()
                for p in parts[1:]:
                    key = key * wide + p
                grams, at = np.unique(key, return_inverse=True)
                columns = [grams // wide ** (size - 1 - k) % wide for k in range(size)]
            else:
                grams, at = np.unique(np.stack(parts, axis=1), axis=0, return_inverse=True)
                columns = list(grams.T)
            pair = np.unique(at.ravel() * len(many) + doc[use])
            tf, df_ = np.bincount(at.ravel(), minlength=len(grams)), np.bincount(pair // len(many), minlength=len(grams))
            columns = [number[c - 1] for c in columns] + [np.zeros(len(grams), np.int64)] * (3 - size)
            out.append(np.stack([np.full(len(grams), size), *columns, tf, df_]))
        size, a, b, c, tf, df_ = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), *[pa.array(x) for x in (a, b, c, tf, df_)]], ["size", "a", "b", "c", "tf", "df"])

    each = _texts(df, text, normal, work, "size int, a long, b long, c long, tf long, df long")
    # counted by run already: rows go straight to where they are summed
    return each.repartition("size", "a", "b", "c").groupBy("size", "a", "b", "c").agg(F.sum("tf").alias("term_frequency"), F.sum("df").alias("document_frequency"))


def _dictionary(df: DataFrame, text: str, normal: bool) -> tuple[DataFrame, int]:
    """All words with their numbers, and the salt under which no two words share one."""
    for salt in range(100):
        words = cut(numbered_words(df, text, normal, salt))
        n, distinct = words.agg(F.count("*"), F.count_distinct("number")).first()
        if n == distinct:
            return words, salt
    raise RuntimeError("no numbering tells all words apart")


def _named(counts: DataFrame, words: DataFrame) -> DataFrame:
    """counts with term: the words in place of their numbers."""
    for c in "abc":
        own = words.select(F.col("number").alias(c), F.col("word").alias(f"w{c}"))
        counts = counts.join(own, c, "inner" if c == "a" else "left")
    # numbers beyond size are 0, which may be a word's number too
    term = F.when(F.col("size") == 1, F.col("wa")).when(F.col("size") == 2, F.concat_ws(" ", "wa", "wb")).otherwise(F.concat_ws(" ", "wa", "wb", "wc"))
    return counts.withColumn("term", term)


def ngram_counts(df: DataFrame, text: str = "text", normal: bool = True) -> DataFrame:
    """(term, ngram_size, term_frequency, document_frequency) of 1- to 3-grams."""
    words, salt = _dictionary(df, text, normal)
    return _named(gram_counts(df, text, normal, salt).where("size > 0"), words).select("term", F.col("size").alias("ngram_size"), "term_frequency", "document_frequency")


def vocabulary(df: DataFrame, text: str = "text", top_n: int = 50, normal: bool = True) -> DataFrame:
    """The top_n (500 at most) terms by (1 + ln tf)(1 + ln((N + 1) / (df + 1))).

    N-grams are counted by the numbers of their words; only those that can
    be among the top, ties at its end included, get their words back.
    """
    top_n = min(max(top_n, 0), 500)
    words, salt = _dictionary(df, text, normal)
    counts = cut(gram_counts(df, text, normal, salt))
    n = counts.where("size = 0").agg(F.coalesce(F.sum("document_frequency"), F.lit(0))).first()[0]
    scored = counts.where("size > 0").withColumn("score", F.round((1 + F.log("term_frequency")) * (1 + F.log(F.lit(n + 1.0) / (F.col("document_frequency") + 1.0))), 6))
    order = [F.desc("score"), F.desc("document_frequency"), F.desc("term_frequency")]
    last = scored.select("score", "document_frequency", "term_frequency").orderBy(*order).limit(top_n).tail(1)
    if last:
        rank = F.struct("score", "document_frequency", "term_frequency")
        scored = scored.where(rank >= F.struct(*[F.lit(v).cast(t) for v, t in zip(last[0], ("double", "long", "long"), strict=True)]))
    return _named(scored, words).select("term", F.col("size").alias("ngram_size"), "term_frequency", "document_frequency", "score").orderBy(*order, "term").limit(top_n)


def _cluster_terms(df: DataFrame) -> DataFrame:
    """(label, term, tf): uni- and bigrams of each cluster's texts, joined in row order, so that bigrams cross from one text to the next."""
    rows = df.where("label <> -1").select("label", "idx", label_tokens("text").alias("t"))
    tokens = rows.select("label", "idx", F.posexplode("t").alias("k", "w"))
    singles = tokens.groupBy("label", F.col("w").alias("term")).agg(F.count("*").alias("tf"))
    inside = rows.select("label", F.explode(ngrams("t", 2)).alias("term")).groupBy("label", "term").agg(F.count("*").alias("tf"))
    # across texts: the last word of the text before, which is the nearest one with a word
    ends = rows.where(F.size("t") > 0).select("label", F.element_at("t", 1).alias("head"), F.lag(F.element_at("t", -1)).over(Window.partitionBy("label").orderBy("idx")).alias("tail"))
    across = ends.where("tail IS NOT NULL").groupBy("label", F.concat_ws(" ", "tail", "head").alias("term")).agg(F.count("*").alias("tf"))
    return singles.unionByName(inside).unionByName(across).groupBy("label", "term").agg(F.sum("tf").alias("tf"))


def ctfidf(df: DataFrame, top_n: int = 5, max_features: int = 5000) -> DataFrame:
    """(label, rank, term, score): class-based TF-IDF of df(idx, text, label). Only the max_features most frequent terms count; stopwords enter the lengths but not the ranking."""
    tf = _cluster_terms(df)
    common = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "term").limit(max_features)
    kept = tf.join(F.broadcast(common), "term")
    n = df.where("label <> -1").agg(F.count_distinct("label").alias("n"))
    length = kept.groupBy("label").agg(F.sum("tf").alias("length"))
    scored = kept.join(F.broadcast(length), "label").join(F.broadcast(n)).withColumn("score", F.col("tf") / F.col("length") * F.log(1 + F.col("n") / (F.col("df") + 1)))
    wanted = scored.where(~F.exists(F.split("term", " "), lambda w: F.array_contains(strings(W.LABEL_STOPWORDS), w)))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("score", 12)), F.desc("term")))
    return wanted.select("label", "term", F.round("score", 6).alias("score"), rank.alias("rank")).where(F.col("rank") <= top_n)


def label_clusters(df: DataFrame, top_n: int = 5) -> DataFrame:
    """(label, name, keywords, size) of every cluster but noise."""
    sizes = df.where("label <> -1").groupBy("label").agg(F.count("*").alias("size"))
    keys = ctfidf(df, top_n).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("k"))
    keywords = F.coalesce(F.transform("k", lambda x: x["term"]), strings([]))
    return sizes.join(F.broadcast(keys), "label", "left").select("label", cluster_label(keywords).alias("name"), keywords.alias("keywords"), "size")


def expansion_quality(df: DataFrame, original: str = "original", enriched: str = "enriched", terms: str = "domain_terms", confidence: str = "confidence") -> DataFrame:
    """df with the metrics, warnings, risk and adjusted confidence of each expanded text against its original."""
    o, e = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(enriched), F.lit(""))
    t = df.withColumns({"__ot": quality_tokens(o), "__et": quality_tokens(e), "__om": meaning_tokens(o), "__em": meaning_tokens(e), "__terms": domain_terms(terms), "__new": F.array_sort(F.array_except(numbers(e), numbers(o)))})
    ratio = F.when(F.size("__ot") > 0, F.size("__et") / F.size("__ot"))
    distinct = F.array_distinct("__om")
    overlap = F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, "__em")) / F.size(distinct)).otherwise(1.0)
    coverage = F.when(F.size("__terms") > 0, F.size(F.filter("__terms", lambda x: F.contains(F.lower(e), x))) / F.size("__terms"))
    missing = F.slice(F.array_except("__om", "__em"), 1, 25)
    t = t.withColumns({"__ratio": ratio, "__overlap": overlap, "__cover": coverage, "__missing": missing})

    def says(tokens: str, *which: str) -> Column:
        return F.arrays_overlap(F.col(tokens), strings(list(which)))

    stronger = says("__ot", "may", "should") & says("__et", "shall", "must")
    omits = F.coalesce((F.size(distinct) > 0) & (F.size("__missing") / F.size(distinct) > 0.4), F.lit(False))
    short, long_, low = F.coalesce(F.col("__ratio") < 0.75, F.lit(False)), F.coalesce(F.col("__ratio") > 4.0, F.lit(False)), F.col("__overlap") < 0.45
    invented = F.size("__new") > 0
    risk = clamp(F.when(invented, 0.25).otherwise(0.0) + F.when(stronger, 0.25).otherwise(0.0) + F.when(low, 0.2).otherwise(0.0) + F.when(short | long_, 0.15).otherwise(0.0) + F.when(omits, 0.15).otherwise(0.0))
    base = F.when(F.col(confidence).isNull(), 0.5).otherwise(clamp(F.col(confidence)))
    said = [
        (e == "", "Expanded text is empty."), (short, "Expanded text is too short compared with the original requirement."),
        (long_, "Expanded text is too long compared with the original requirement."), (low & (F.size(distinct) > 0), "Lexical overlap with the original requirement is very low."),
        (omits, "Expanded text omits many critical tokens from the original requirement."), (invented, "Expanded text introduces numeric values not present in the original requirement."),
        (stronger, "Expanded text strengthens obligation language from may/should to shall/must."),
    ]
    return t.select(
        *df.columns, F.round("__ratio", 6).alias("length_ratio"), F.round("__overlap", 6).alias("lexical_overlap"), F.round("__cover", 6).alias("domain_term_coverage"),
        F.col("__missing").alias("missing_tokens"), F.col("__new").alias("invented_numbers"), stronger.alias("changed_obligation"),
        F.round(risk, 6).alias("risk"), F.round(clamp(base * (1 - risk)), 6).alias("adjusted_confidence"),
        F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in said])).alias("warnings"))


def quality_summary(report: DataFrame) -> DataFrame:
    """Totals and means of a quality report with a column status, and the distinct warnings."""
    ok = F.col("status") == "succeeded"
    total = report.agg(F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.round(F.avg(F.when(ok, F.col("risk"))), 6).alias("mean_risk"), F.round(F.avg(F.when(ok, F.col("adjusted_confidence"))), 6).alias("mean_confidence"))
    seen = report.select(F.posexplode("warnings").alias("k", "w"), "idx").groupBy("w").agg(F.min(F.struct("idx", "k")).alias("at")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("warnings"))
    return total.join(seen)
