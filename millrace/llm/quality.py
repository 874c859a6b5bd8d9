"""Line-first cleaning, in DataFrame expressions only.

Every line is judged by itself: its punctuation, its likeness to navigation and its
boilerplate phrases. Lines that fail are removed, and a document is rejected when too
much of its text goes with them. Rates of the whole document (few words, repeated
windows of words) are the base rules, which come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, fresh_name

WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5
BASE_SYMBOLS = "#*$%&|<>"

#: Phrases of pages rather than of texts; a line of up to ``SHORT`` words with one of
#: them is boilerplate. In a longer line a phrase is a small part.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "click here", "enable javascript",
    "lorem ipsum", "powered by", "privacy policy", "read more", "share this", "sign up for",
    "skip to content", "subscribe to", "terms of service", "terms of use",
)

SHORT = 24

#: Marks that separate the entries of menus and decorate markup.
MARKS = r"[#*$%&|<>{}=~^_\\»›•·]"


def _occurrences(text: Column, part: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part.encode()))


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda kept, c: F.replace(kept, F.lit(c), F.lit("")), characters, text)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))


def with_base_rates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long).

    Windows of words are compared by 64-bit hashes of the hashes of their words. Only
    documents in which two windows agree have their windows sorted.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    rates = docs.withColumn("_hashes", F.transform(words_of(F.col(text)), lambda word: F.xxhash64(word)))
    rates = rates.withColumn("_lines", lines)
    ahead = [lambda i, k=k: F.get(F.col("_hashes"), i + k) for k in range(1, WINDOW)]
    windows = F.transform(F.col("_hashes"), lambda x, i: F.xxhash64(x, *[get(i) for get in ahead]))
    n = F.size("_hashes")
    rates = rates.withColumn("_windows", F.slice(windows, F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    numbered = F.transform(F.col("_windows"), lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    rates = rates.withColumn("_sorted", F.when(repeats, F.sort_array(numbered)))

    def found_again(item: Column, k: Column) -> Column:
        same = lambda j: F.get(F.col("_sorted"), j)["h"].eqNullSafe(item["h"])
        return same(k - 1) | same(k + 1)

    rates = rates.withColumn("_starts", F.sort_array(F.transform(F.filter("_sorted", found_again), lambda item: item["i"])))
    covered = F.transform("_starts", lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(F.col("_starts"), k - 1))))
    return rates.select(
        *[F.col(c) for c in docs.columns],
        n.cast("long").alias("n_words"),
        F.char_length(_without(whole, SPACES)).cast("long").alias("word_chars"),
        (F.octet_length(whole) - F.octet_length(_without(whole, BASE_SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_passes(line: Column) -> Column:
    """Whether one line stays. Blank lines do.

    * navigation: a mark of menus or markup for every fourth word or more;
    * punctuation: a doubled exclamation mark for every third word or more, or, in a
      line of eight words or more, no mark that ends a sentence or a clause at all;
    * boilerplate: a phrase of ``BOILERPLATE`` in a line of ``SHORT`` words or fewer.
    """
    bare = F.btrim(line, F.lit(SPACES))
    words = _occurrences(bare, " ") + 1
    marks = F.char_length(bare) - F.char_length(F.regexp_replace(bare, MARKS, ""))
    loud = _occurrences(bare, "!!")
    flat = (words >= 8) & ~reduce(lambda a, b: a | b, [bare.contains(c) for c in ".,;:!?…"])
    lower = F.lower(F.when(words <= SHORT, bare))
    boiler = (words <= SHORT) & reduce(lambda a, b: a | b, [lower.contains(phrase) for phrase in BOILERPLATE])
    fails = ((marks >= 2) & (4 * marks >= words)) | ((loud >= 2) & (3 * loud >= words)) | flat | boiler
    return (bare == "") | ~fails


def with_clean_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add cleaned (the lines that pass; null for a null text), n_lines,
    n_lines_removed and lost_chars (code points of removed lines)."""
    judged = docs.withColumn("_judged", F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda line: F.struct(line.alias("line"), line_passes(line).alias("passes"))))
    removed = F.filter("_judged", lambda x: ~x["passes"])
    judged = judged.withColumn("_removed", F.transform(removed, lambda x: F.char_length(x["line"])))
    stays = F.transform(F.filter("_judged", lambda x: x["passes"]), lambda x: x["line"])
    return judged.select(
        *[F.col(c) for c in docs.columns],
        F.when(F.col(text).isNotNull(), F.when(F.size("_removed") == 0, F.col(text)).otherwise(F.array_join(stays, "\n"))).alias("cleaned"),
        F.size("_judged").alias("n_lines"),
        F.size("_removed").alias("n_lines_removed"),
        F.aggregate("_removed", F.lit(0), lambda total, x: total + x).cast("long").alias("lost_chars"),
    )


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "cleaned", "n_lines", "n_lines_removed", "lost_chars", "base_failed", "kept")


def with_verdict(docs: DataFrame, name: str, max_lost: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """Every column of ``docs`` (text among them), whatever its name, and the verdict as
    a struct column ``name``: the columns of :func:`with_base_rates` and
    :func:`with_clean_text`, base_failed, and kept, which is false if base_failed or if
    removed lines hold more than ``max_lost`` of the text's code points.

    Null and empty texts have no words, so they fail the base rules; repeated rows get
    the same verdict each; an empty table gives no rows.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    text = own[docs.columns.index("text")]
    judged = with_clean_text(with_base_rates(docs.toDF(*own), text), text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    lost = F.col("lost_chars") > F.lit(max_lost) * F.char_length(F.coalesce(text, F.lit("")))
    # Through a generator, below which the optimizer can't push a filter on the verdict:
    # it would evaluate all that the verdict rests on again inside that filter.
    verdict = F.explode(F.array(F.struct(failed.alias("base_failed"), (~failed & ~lost).alias("kept"))))
    judged = judged.select("*", verdict.alias("verdict"))
    results = F.struct(*[F.col(c) for c in RESULTS[:-2]], *[F.col(f"verdict.{c}").alias(c) for c in RESULTS[-2:]])
    return judged.select(*[F.col(c).alias(d) for c, d in zip(own, docs.columns, strict=True)], results.alias(name))


def judge_documents(docs: DataFrame, **limits) -> DataFrame:
    """Every column of ``docs`` and those of the verdict; see :func:`with_verdict`.
    Columns of ``docs`` with the name of a result are replaced by it."""
    plain = docs.select(*[c for c in docs.columns if c not in RESULTS])
    verdict = fresh_name(plain, "_verdict")
    judged = with_verdict(plain, verdict, **limits)
    return judged.select(*plain.columns, *[F.col(verdict)[c].alias(c) for c in RESULTS])


def oracle(max_lost: float = 0.5, min_words: int = 10, max_repeat_percent: int = 20) -> str:
    """The verdicts of :func:`judge_documents` in DuckDB SQL, which compares windows
    word by word instead of by hash."""
    blank = " || ".join(f"chr({ord(c)})" for c in SPACES)
    count = lambda part: f"(length(bare) - length(replace(bare, '{part}', ''))) / {len(part)}.0"
    boiler = " OR ".join(f"contains(lower(bare), '{phrase}')" for phrase in BOILERPLATE)
    pauses = " OR ".join(f"contains(bare, '{c}')" for c in ".,;:!?…")
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, text IS NOT NULL AS known,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), starts AS (
  SELECT row, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] AS win, i
  FROM (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM docs)
), again AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM starts) WHERE n > 1
), repeated AS (
  SELECT row, CAST(sum(least({WINDOW}, coalesce(i - last, {WINDOW}))) AS BIGINT) AS n_repeat_words
  FROM (SELECT row, i, lag(i) OVER (PARTITION BY row ORDER BY i) AS last FROM again) GROUP BY row
), lines AS (
  SELECT row, line, trim(line, {blank}) AS bare, number FROM (SELECT row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS number FROM docs)
), judged AS (
  SELECT *, bare <> '' AND ((marks >= 2 AND 4 * marks >= n) OR (loud >= 2 AND 3 * loud >= n) OR (n >= 8 AND NOT ({pauses})) OR (n <= {SHORT} AND ({boiler}))) AS fails
  FROM (SELECT *, {count(" ")} + 1 AS n, {count("!!")} AS loud, length(bare) - length(regexp_replace(bare, '{MARKS}', '', 'g')) AS marks FROM lines)
), counted AS (
  SELECT row, count(line) FILTER (bare <> '') - count(DISTINCT line) FILTER (bare <> '') AS n_dup_lines,
         coalesce(sum(length(line)) FILTER (fails), 0) AS lost, count(*) FILTER (fails) AS n_lines_removed,
         coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (NOT fails), '') AS cleaned
  FROM judged GROUP BY row
), rated AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[{BASE_SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(n_dup_lines AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost, length(text) AS n_chars,
         CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CASE WHEN known THEN md5(cleaned) END AS cleaned_md5
  FROM docs JOIN counted USING (row) LEFT JOIN repeated USING (row)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed,
       NOT (n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words) AND NOT (lost > {max_lost} * n_chars) AS kept,
       n_lines_removed, cleaned_md5
FROM rated"""
