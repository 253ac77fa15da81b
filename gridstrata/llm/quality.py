"""Quality rules, line first, in DataFrame functions only.

measured() adds the base counts of each text. cleaned() drops lines that fail a punctuation, navigation or boilerplate
rule, then rejects documents that lose too much text. Everything is computed within a row: there is no shuffle, so
neither a hot source nor a group of copies matters.

Null text counts as empty: no words, base_failed. Columns of a document that have the names added here, in
either case, are replaced; others stay, whatever their names.
Words repeat as exact strings: the five-word windows of a text are made and sorted only where two of their hashes are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstrata.llm.common import SPACE, WORD, free_names, words

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

#: Line rules. A line fails when marks make up a tenth or more of its characters (three marks at least), when it is cut
#: into short fields by separators, or when it is short and holds a phrase of page furniture.
MARKS, LEAST_MARKS, MARK_SHARE = "#*$%&|<>!?~^=_@", 3, 10
SEPARATORS, LEAST_SEPARATORS, FIELD_WORDS = "|»›•·>", 2, 4
SHORT_WORDS = 25
PHRASES = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "javascript is disabled", "log in to", "privacy policy",
    "read more", "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use", "use of cookies",
)
#: A document is rejected when failed lines hold more than this share of its characters, in percent.
MOST_LOST = 50

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _only(text: Column, characters: str) -> Column:
    """How many of the characters a text holds."""
    return F.length(F.regexp_replace(text, f"[^{_class(characters)}]+", ""))


def _class(characters: str) -> str:
    return "".join("\\" + c if c in r"\^]-[&" else c for c in characters)


def _here() -> Column:
    """True, but nothing is moved across it: a filter on our columns, pushed below the projections, would repeat their
    array expressions within each other."""
    return F.monotonically_increasing_id() >= 0


def _has_word(line: Column) -> Column:
    return line.rlike(WORD)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns BASE."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in BASE]
    own = free_names(docs)
    t = F.coalesce(F.col(text), F.lit(""))
    # one projection a step, so that each array is made once and read by position
    step = docs.select("*", words(F.col(text)).alias(own("words")), F.filter(F.split(t, "\n"), _has_word).alias(own("lines")))
    n = F.size(own("words"))
    window = lambda i: F.concat_ws(" ", *[F.get(F.col(own("words")), i + k) for k in range(WINDOW)])
    # hashes first: only a text in which two windows have one hash gets its windows as strings, to be compared as such
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(own("words"), i, WINDOW)))
    step = step.withColumn(own("hashes"), F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<long>")))
    again = F.size(F.array_distinct(own("hashes"))) < F.size(own("hashes"))
    step = step.withColumn(own("windows"), F.when(again, F.transform(F.sequence(F.lit(0), n - WINDOW), window)))
    step = step.withColumn(own("sorted"), F.sort_array(F.transform(own("windows"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    at = lambda i: F.get(F.col(own("sorted")), i)["w"]
    twice = lambda x, i: F.when(F.coalesce((at(i - 1) == x["w"]) | (at(i + 1) == x["w"]), at(i - 1) == x["w"], at(i + 1) == x["w"], F.lit(False)), x["i"])
    step = step.withColumn(own("places"), F.sort_array(F.filter(F.transform(own("sorted"), twice), lambda p: p.isNotNull())))
    covered = F.transform(own("places"), lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(own("places")), i + 1) - p, F.lit(WINDOW))))
    total = lambda array: F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + x)
    step = step.select(
        *keep,
        n.cast("long").alias("n_words"),
        total(F.transform(own("words"), F.length)).alias("word_chars"),
        _only(t, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(own("lines")) - F.size(F.array_distinct(own("lines")))).cast("long").alias("n_dup_lines"),
        F.when(_here(), F.coalesce(total(covered), F.lit(0)).cast("long")).alias("n_repeat_words"),
    )
    return step.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def line_fails(line: Column) -> Column:
    """Whether a line fails one of the line rules; a line without a word never does."""
    n_words, chars = F.regexp_count(line, F.lit(WORD)), F.length(F.regexp_replace(line, SPACE + "+", ""))
    marks, cuts = _only(line, MARKS), _only(line, SEPARATORS)
    punctuation = (marks >= LEAST_MARKS) & (MARK_SHARE * marks >= chars)
    navigation = (cuts >= LEAST_SEPARATORS) & (n_words <= FIELD_WORDS * (cuts + 1) + cuts)
    boilerplate = (n_words <= SHORT_WORDS) & F.lower(line).rlike("|".join(PHRASES))
    return punctuation | navigation | boilerplate


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with BASE, n_lines_failed, cleaned (the text without failed lines), and kept."""
    own = free_names(docs)
    base = measured(docs, text)
    base = base.withColumn(own("split"), F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    # a line without any mark, separator or phrase can't fail: most texts stop here
    t = F.coalesce(F.col(text), F.lit(""))
    suspect = t.rlike(f"[{_class(MARKS + SEPARATORS)}]")
    for phrase in PHRASES:
        suspect = suspect | F.lower(t).contains(phrase)
    base = base.withColumn(own("bad"), F.when(suspect, F.transform(own("split"), line_fails)).otherwise(F.array_repeat(F.lit(False), F.size(own("split")))))
    left = F.array_join(F.filter(own("split"), lambda _, i: ~F.get(F.col(own("bad")), i)), "\n")
    base = base.withColumn("n_lines_failed", F.size(F.filter(own("bad"), lambda x: x)).cast("long")).withColumn("cleaned", F.when(F.col("n_lines_failed") > 0, left).otherwise(F.col(text)))
    chars = F.aggregate(F.split(F.coalesce(F.col("cleaned"), F.lit("")), SPACE + "+"), F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    # words hold all characters that aren't white space
    lost = F.when(F.col("n_lines_failed") > 0, 100 * (F.col("word_chars") - chars) > MOST_LOST * F.col("word_chars")).otherwise(F.lit(False))
    return base.withColumn("kept", _here() & ~F.col("base_failed") & ~lost).drop(own("split"), own("bad"))


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of cleaned() that are kept."""
    return cleaned(docs, text).where("kept")


def _sql_class(characters: str) -> str:
    return _class(characters).replace("'", "''")


#: DuckDB SQL for doc_id, BASE and kept over documents.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda x: x <> '') AS words, string_split(t, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WINDOW - 2}, 1))) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS line FROM w),
m AS (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}')) AS nw, length(regexp_replace(line, '{SPACE}', '', 'g')) AS chars,
             length(regexp_replace(line, '[^{_sql_class(MARKS)}]', '', 'g')) AS marks, length(regexp_replace(line, '[^{_sql_class(SEPARATORS)}]', '', 'g')) AS cuts FROM l),
f AS (SELECT doc_id, sum(CASE WHEN (marks >= {LEAST_MARKS} AND {MARK_SHARE} * marks >= chars) OR (cuts >= {LEAST_SEPARATORS} AND nw <= {FIELD_WORDS} * (cuts + 1) + cuts)
                               OR (nw <= {SHORT_WORDS} AND regexp_matches(lower(line), '{"|".join(PHRASES)}')) THEN chars ELSE 0 END) AS lost,
             count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS dup FROM m GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
             length(regexp_replace(t, '[^{_sql_class(SYMBOLS)}]', '', 'g')) AS n_symbols, f.dup AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, f.lost
      FROM w JOIN f ON w.doc_id = f.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
       NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost <= {MOST_LOST} * word_chars AS kept
FROM b
"""
