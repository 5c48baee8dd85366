"""Line-first quality rules in DataFrame expressions alone."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = "[ \\x09-\\x0D]+"
_INK = "[^ \\x09-\\x0D]"
_SYMBOL = "[#*$%&|<>]"
#: Phrases of site furniture.
BOILERPLATE = ["accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign up now", "subscribe to our", "terms of service", "terms of use"]


def line_faults(line: Column, symbols: Column) -> dict[str, Column]:
    """Rule name -> whether a line (with a word) fails it; symbols: how many it has.

    punctuation: symbols over a tenth of its characters, or exclamation and
    question marks over a twentieth of at least 20; navigation: three or
    more bars, one in 20 characters or more; boilerplate: under 200
    characters with a phrase of site furniture; shouting: at least 20
    characters with capital and no small letters.
    """
    n = F.length(line)
    bars = F.regexp_count(line, F.lit("\\|"))
    marks = (n >= 20) & (F.contains(line, F.lit("!")) | F.contains(line, F.lit("?"))) & (F.regexp_count(line, F.lit("[!?]")) * 20 > n)
    return {
        "punctuation": (symbols * 10 > n) | marks,
        "navigation": (symbols >= 3) & (bars >= 3) & (bars * 20 >= n),
        "boilerplate": (n < 200) & F.lower(line).rlike("|".join(BOILERPLATE)),
        "shouting": (n >= 20) & ~line.rlike("\\p{Ll}") & line.rlike("\\p{Lu}"),
    }


def repeated_words(df: DataFrame, words: str, out: str, width: int = 3) -> DataFrame:
    """df with out: how many of the words (an array column) stand in width-word windows that occur twice or more among them, the first occurrence included.

    Windows are told apart by 64-bit hashes. Most texts have no two equal
    ones, which a hash set shows; of the rest, sorted hashes give the values
    that recur, and then their places: one by one where they are few, by
    sorting the places along with the hashes where they are many.
    """
    last = F.size(words) - width
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    names = [F.col(c) for c in df.columns]
    df = df.select(*names, F.when(last >= 0, hashes).alias("__h"))
    df = df.select(*names, "__h", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array("__h")).alias("__s"))
    df = df.select(*names, "__h", "__s", F.array_distinct(F.filter("__s", lambda x, j: F.get("__s", j + 1) == x)).alias("__d"))
    few = F.filter(F.sequence(F.lit(0), F.size("__h") - 1), lambda i: F.array_contains(F.col("__d"), F.get("__h", i)))
    paired = F.when(F.size("__d") > 64, F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.select(*names, "__h", "__d", paired.alias("__p"))
    same = F.filter("__p", lambda x, j: (F.get("__p", j - 1)["h"] == x["h"]) | (F.get("__p", j + 1)["h"] == x["h"]))
    many = F.sort_array(F.transform(same, lambda x: x["i"]))
    df = df.select(*names, F.when(F.col("__d").isNull(), None).when(F.size("__d") > 64, many).otherwise(few).alias("__at"))
    steps = F.transform("__at", lambda x, j: F.least(F.lit(width), F.coalesce(F.get("__at", j + 1) - x, F.lit(width))))
    return df.select(*names, F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias(out))


def quality_rules(docs: DataFrame, max_lost: int = 30) -> DataFrame:
    """docs with the counts of their words and lines, the text without failing lines, and a verdict.

    First each line with a word is judged alone (line_faults); lines that
    fail are removed. Then a document is rejected when the removed lines
    held over max_lost percent of the characters of its lines with words,
    or when it fails the base rules: under 50 words, or over half of its
    words in repeated three-word windows (told apart by 64-bit hashes within
    one text).

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, lost_chars, line_chars (long), clean_text, kept; columns of
    these names in docs are replaced, all others stay. Words are runs of
    other than ASCII white space. A null text counts as the empty text, has
    no words and is rejected, its clean_text is empty. Ties and repeated
    rows are judged row by row; an empty table gives an empty table.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "line_chars", "clean_text", "kept"]
    docs = docs.drop(*made)
    names = [F.col(c) for c in docs.columns]
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE))
    split = docs.select("*", words.alias("__words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(_INK)).alias("__lines"))
    split = split.select("*", F.transform("__lines", lambda x: F.regexp_count(x, F.lit(_SYMBOL))).alias("__symbols"))
    judged = split.select("*", F.transform("__lines", lambda x, i: reduce(or_, line_faults(x, F.get("__symbols", i)).values())).alias("__bad"))
    judged = repeated_words(judged, "__words", "n_repeat_words")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    counted = judged.select(
        *names, F.size("__words").cast("long").alias("n_words"), F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        total(F.col("__symbols")).alias("n_symbols"), (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        total(F.transform("__lines", lambda x, i: F.when(F.get("__bad", i), F.length(x)).otherwise(0))).alias("lost_chars"), total(F.transform("__lines", F.length)).alias("line_chars"),
        F.array_join(F.filter("__lines", lambda x, i: ~F.get("__bad", i)), "\n").alias("clean_text"))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    # a generator keeps filters on the results from being pushed into, and so repeated in, the expressions above
    made_of = F.struct(*[F.col(c) for c in counted.columns[len(names):]], base.alias("base_failed"))
    held = counted.select(*names, F.explode(F.array(made_of)).alias("__made")).select(*names, "__made.*")
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("line_chars") * max_lost)
    return held.select(*names, *[F.col(c) for c in made[:-1]], kept.alias("kept"))


ORACLE_COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM e)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM many) GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(rep.n_repeat_words, 0) AS n_repeat_words,
        list_filter(l, lambda x:
            len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 > length(x)
            OR (length(x) >= 20 AND len(regexp_extract_all(x, '[!?]')) * 20 > length(x))
            OR (len(regexp_extract_all(x, '\|')) >= 3 AND len(regexp_extract_all(x, '\|')) * 20 >= length(x))
            OR (length(x) < 200 AND regexp_matches(lower(x), '{phrases}'))
            OR (length(x) >= 20 AND NOT regexp_matches(x, '\p{{Ll}}') AND regexp_matches(x, '\p{{Lu}}'))) AS bad,
        l FROM e LEFT JOIN rep USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        coalesce(list_sum(list_transform(bad, lambda x: length(x))), 0) AS lost_chars,
        coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS line_chars FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost_chars <= 30 * line_chars AS kept FROM g
""".replace("{phrases}", "|".join(BOILERPLATE)).replace("{{", "{").replace("}}", "}")
