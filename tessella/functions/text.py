"""Column functions of the text rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def normal_form(text: Column | str, form: str = "NFC") -> Column:
    """Unicode normal form; Spark has no built-in for it."""

    @F.pandas_udf("string")
    def go(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x))

    return go(_col(text))


def clean_text(text: Column | str) -> Column:
    """Tags become blanks, white space collapses, quotes at both ends go; null becomes the empty text."""
    bare = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "<[^>]+>", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ +| +$", ""), F.lit("\"'"))


def plain_text(text: Column | str, max_chars: int | None = None, normal: bool = True) -> Column:
    """NFC, control characters to blanks, white space collapsed and trimmed, cut to max_chars."""
    t = F.coalesce(_col(text), F.lit(""))
    t = normal_form(t) if normal else t
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "), r"(?U)\s+", " "))
    return F.substring(t, 1, max_chars) if max_chars is not None else t


def domain_terms(terms: Column | str, cap: int = 50) -> Column:
    """Each term plain, at most 80 characters, lower-cased, without outer punctuation; repeats keep their first place. Lower-casing stands for case folding."""
    each = F.transform(_col(terms), lambda t: F.btrim(F.lower(F.substring(F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", " ")), 1, 80)), F.lit(" ,.;:()[]{}")))
    return F.slice(F.array_distinct(F.filter(each, lambda t: t != "")), 1, cap)


def dedupe_fold(values: Column | str, cap: int) -> Column:
    """Drop blanks and repeats that differ in case only, keeping the first; at most cap."""
    kept = F.filter(F.transform(_col(values), lambda v: F.trim(v)), lambda v: v != "")
    lower = F.transform(kept, F.lower)
    first = F.filter(kept, lambda v, i: F.array_position(lower, F.lower(v)) == i + 1)
    return F.slice(first, 1, cap)


def label_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(W.LABEL_TOKEN), 0)


def vocabulary_tokens(text: Column | str, normal: bool = True) -> Column:
    t = F.coalesce(_col(text), F.lit(""))
    t = F.regexp_replace(F.lower(normal_form(t, "NFKC") if normal else t), r"[^a-z0-9\-\s]+", " ")
    stop = strings(W.REQUIREMENT_STOPWORDS)
    return F.filter(F.regexp_extract_all(t, F.lit(W.VOCABULARY_TOKEN), 0), lambda x: ~F.array_contains(stop, x))


def ngrams(tokens: Column | str, n: int) -> Column:
    t = _col(tokens)
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(strings([]))


def quality_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(W.QUALITY_TOKEN), 0)


def meaning_tokens(text: Column | str) -> Column:
    stop = strings(W.REQUIREMENT_STOPWORDS)
    return F.filter(quality_tokens(text), lambda t: ~F.array_contains(stop, t) & ((F.length(t) >= 3) | t.rlike("^[0-9]+$")))


def numbers(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(text)), F.lit(W.NUMBER), 0))


def salient_tokens(text: Column | str) -> Column:
    stop = strings(W.LABEL_STOPWORDS)
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(_col(text)), F.lit(W.SALIENT_TOKEN), 0), lambda t: ~F.array_contains(stop, t)))


def requirement_ids(text: Column | str) -> Column:
    """Normalised identifiers in a text, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_col(text), F.lit("(?i)" + W.REQ_ID), 0), normal_id))


def normal_id(value: Column | str) -> Column:
    return F.upper(F.regexp_replace(_col(value), "[-_ ]", ""))


def first_cue(text: Column | str, cues: list[str]) -> Column:
    """The first of the list (not of the text) that the text contains, trimmed; null if none does."""
    lower = F.lower(_col(text))
    return F.trim(F.get(F.filter(strings(cues), lambda c: F.contains(lower, c)), F.lit(0)))


def has_verb(text: Column | str, verbs: list[str]) -> Column:
    """Whether a word begins with one of the verbs."""
    return F.lower(_col(text)).rlike("\\b(?:" + "|".join(verbs) + ")")


def components(text: Column | str, terms: Column | str, cap: int = 50) -> Column:
    named = F.filter(_col(terms), lambda t: t.rlike("|".join(W.COMPONENT_PARTS)))
    return dedupe_fold(F.concat(F.regexp_extract_all(_col(text), F.lit(W.COMPONENT), 0), named), cap)


def intent(text: Column | str) -> Column:
    """The text after 'the system shall' and its like, without outer blanks and stops; the text itself if nothing is left or no such opening is there."""
    t = _col(text)
    rest = F.btrim(F.regexp_replace(t, "(?i)^(the )?system (shall|must|should|may) ", ""), F.lit(" ."))
    return F.when(F.lower(t).rlike("^(the )?system (shall|must|should|may) ") & (rest != ""), rest).otherwise(t)


def cluster_label(keywords: Column | str, max_words: int = 4) -> Column:
    """The first distinct words of the keywords, capitalised."""
    all_words = F.array_distinct(F.filter(F.split(F.lower(F.array_join(_col(keywords), " ")), " +"), lambda w: w != ""))
    said = F.transform(F.slice(all_words, 1, max_words), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.when(F.size(all_words) > 0, F.array_join(said, " ")).otherwise("Uncategorized")


def comment_confidence(comment: Column | str, label: Column | str, keywords: Column | str) -> Column:
    """1.0 for a blank comment, else 0.5 and a tenth per point, 1.0 at most: two points for each keyword in the comment, or else one for each of its words of over three letters there; two for each such word of the label."""
    c, low = _col(comment), F.lower(_col(comment))

    def long_words(t: Column) -> Column:
        return F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"\w+"), 0), lambda w: (F.length(w) > 3) & F.contains(low, w))

    of_keys = F.aggregate(_col(keywords), F.lit(0), lambda a, k: a + F.when(F.contains(low, F.lower(k)), 2).otherwise(F.size(long_words(k))))
    points = of_keys + 2 * F.size(long_words(_col(label)))
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(1.0)).otherwise(F.bround(0.5 + F.least(points * F.lit(0.1), F.lit(0.5)), 2))


def narrative(summary: Column | str) -> Column:
    suffix = " (Manually refined by expert analyst)."
    s = F.trim(F.coalesce(_col(summary), F.lit("")))
    s = F.when(s == "", "This cluster contains functionally related requirements.").otherwise(s)
    return F.when(F.contains(s, F.lit(suffix)), s).otherwise(F.concat(s, F.lit(suffix)))


def redact_secrets(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"sk-[A-Za-z0-9_-]+", "[redacted]")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
