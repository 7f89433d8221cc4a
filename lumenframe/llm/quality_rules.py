"""Quality rules: a threshold table compiled into one Spark projection, with no user functions.

Counts are taken over the whole text. Words are runs of characters other than space, tab, line feed, vertical tab,
form feed and carriage return. A null text counts as an empty one: it has no words, so it fails the base rule.
Texts of any length are counted whole, an empty table gives an empty one, and a row without an id is judged like any
other. Repeated rows give repeated results; the columns of the input besides the id and the text are not looked at, so
extra columns with clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table

#: Characters counted as symbols (fixed by the contract of op5).
SYMBOLS = "#*$%&|<>"

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "a", "an", "at", "from", "his", "but", "have", "which",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "er", "sie", "ver",
    "de", "la", "le", "et", "les", "du", "en", "un", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "plus", "avec", "se", "ce", "des",
    "el", "y", "los", "las", "del", "por", "con", "una", "su", "para", "no", "al", "lo", "como", "o",
]

#: Words of a window whose repetition counts.
WINDOW = 8

#: name, expression over the counts, lowest and highest value that passes (None: no bound). A rule whose expression
#: is null (nothing to divide by) passes.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars / n_words", 2.0, 16.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.25),
    ("upper_share", "n_upper / n_letters", None, 0.5),
    ("stop_word_share", "n_stop / n_words", 0.02, None),
    ("duplicate_line_share", "n_dup_lines / n_lines", None, 0.5),
    ("bullet_line_share", "n_bullet_lines / n_lines", None, 0.9),
    ("ellipsis_line_share", "n_ellipsis_lines / n_lines", None, 0.3),
]


def verdict(rules: list[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """The threshold table as one boolean column."""
    out = F.lit(True)
    for _, expression, low, high in rules:
        top, bottom = expression.split("/")
        value = F.try_divide(F.expr(top).cast("double"), F.expr(bottom).cast("double"))
        for bound, passes in ((low, lambda v, b: v >= b), (high, lambda v, b: v <= b)):
            if bound is not None:
                out = out & F.coalesce(passes(value, F.lit(float(bound))), F.lit(True))
    return out


def _let(name: str, value: str, then: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``then``, however often a filter is pushed into it."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def repeated_words(words: str, window: int = WINDOW) -> str:
    """SQL for the number of words of an array that lie in windows found at two or more places."""
    hashes = ", ".join(f"h[i + {j}]" for j in range(window))
    order = "sort_array(transform(v, (x, i) -> struct(x AS h, i AS p)))"
    places = "sort_array(transform(filter(s, (x, j) -> (j > 0 AND get(s, j - 1).h = x.h) OR get(s, j + 1).h = x.h), x -> x.p))"
    count = f"aggregate(p, named_struct('n', 0L, 'e', 0), (a, x) -> named_struct('n', a.n + x + {window} - greatest(x, a.e), 'e', x + {window}), a -> a.n)"
    some = _let("s", order, _let("p", places, count))
    return _let("h", f"transform({words}, w -> xxhash64(w))", f"CASE WHEN size(h) > {window} THEN " + _let("v", f"transform(sequence(0, size(h) - {window}), i -> xxhash64({hashes}))", f"CASE WHEN size(array_distinct(v)) < size(v) THEN {some} ELSE 0L END") + " ELSE 0L END")


def measure(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every document's counts: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and those of RULES.

    n_repeat_words: words covered by windows of WINDOW words that start at two or more places of the same text.
    Window hashes are sorted with their places, so a text of n words takes n log n time however repetitive it is.
    """
    t = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("k", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"), F.split("t", "\n").alias("l"))
    t = t.select("k", "t", "w", F.filter("l", lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("l"), F.size("w").alias("n"))
    left = lambda drop: F.length("t") - F.length(F.translate("t", drop, ""))
    return t.select(
        F.col("k").alias(key),
        F.col("n").cast("long").alias("n_words"),
        (F.length("t") - left(SPACES)).cast("long").alias("word_chars"),
        left(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated_words("w")).alias("n_repeat_words"),
        F.size(F.filter("w", lambda w: w.isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"^\s*[-*•|]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{L}", ""))).cast("long").alias("n_letters"),
    )


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: list[tuple[str, str, float | None, float | None]] = RULES) -> DataFrame:
    """Counts and verdict of every document: ``base_failed`` for under 20 words or over 30 % repeated, then ``kept``."""
    m = measure(docs, text, key)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("kept", ~base & verdict(rules))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the rules over every document."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql(rules: list[tuple[str, str, float | None, float | None]] = RULES) -> str:
    """DuckDB SQL of op5, from the same threshold table."""
    space = r"[\x20\x09-\x0D]"
    stops = ", ".join("'" + w + "'" for w in dict.fromkeys(STOP_WORDS))
    passes = []
    for _, expression, low, high in rules:
        top, bottom = expression.split(" / ")
        value = f"({top})::DOUBLE / nullif({bottom}, 0)"
        passes += [f"coalesce({value} {op} {bound}, true)" for op, bound in ((">=", low), ("<=", high)) if bound is not None]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '{space}', '', 'g')) > 0) AS l
  FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g, range({WINDOW}) q(j) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•|]'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines,
         length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(passes)} AS kept
FROM m
"""


OP5_SQL = _sql()
