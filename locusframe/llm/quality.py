"""Quality rules: a table of thresholds compiled into one projection, without user functions and without a shuffle.

Edge cases: a null or empty text has no words, so it fails the base rule; a document of under eight words has no
window; lines count with a word only; every count covers the whole text. Rows that repeat are judged one by one,
extra columns are carried along, those named like an added one (``q_*`` as listed in COUNTS, and the verdicts) replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, table, unused, words

WINDOW = 8
#: Frequent function words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this from or at an he his they have not but which you "
    "le la les de des du un une et que qui en dans est pour sur par ou ce se "
    "der die das und von zu mit den ist nicht ein eine auf für im dem sich "
    "el los las del y se lo con una no por su para como es al más"
).split()
#: name, smallest and largest allowed value; None leaves a side open. A document is kept if every rule holds.
RULES: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.3),
    ("stop_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.5),
    ("repeat_ratio", None, 0.3),
    ("upper_ratio", None, 0.6),
)

#: Columns that quality_counts works with and drops.
STEPS = ("__q_words", "__q_lines", "__q_may_repeat", "__q_windows", "__q_starts")
#: Columns that quality_counts adds.
COUNTS = ("q_n_words", "q_word_chars", "q_n_symbols", "q_n_dup_lines", "q_n_lines", "q_n_repeat_words", "q_n_stop", "q_n_upper")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def quality_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts that the rules use, as columns named ``q_*``."""
    aside = {}
    for c in docs.columns:
        if c.lower() in STEPS:  # a column of the table's own: it has another name meanwhile
            aside[c] = unused(docs, f"_{c}")
            docs = docs.withColumnRenamed(c, aside[c])
    text = F.coalesce(F.col("text"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    d = docs.withColumn("__q_words", words(text)).withColumn("__q_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(has_word)))
    d = d.withColumn("q_n_words", F.size("__q_words"))
    d = d.withColumn(
        # A hash of each window tells the texts that may repeat one; only those are compared word by word.
        "__q_may_repeat",
        F.when(F.col("q_n_words") <= WINDOW, False).otherwise(
            F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("q_n_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__q_words"), i, WINDOW)))))
            < F.col("q_n_words") - (WINDOW - 1)
        ),
    )
    # Windows in the order of their words; equal ones stand together.
    d = d.withColumn(
        "__q_windows",
        F.when(
            F.col("__q_may_repeat"),
            F.sort_array(F.transform(F.sequence(F.lit(1), F.col("q_n_words") - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice(F.col("__q_words"), i, WINDOW), " ").alias("k"), i.alias("i")))),
        ),
    )
    # get() is null beyond the ends; <=> makes that false.
    d = d.withColumn(
        "__q_starts",
        F.when(
            F.col("__q_may_repeat"),
            F.sort_array(
                F.transform(
                    F.filter(
                        "__q_windows",
                        lambda x, at: x["k"].eqNullSafe(F.get(F.col("__q_windows"), at - 1)["k"]) | x["k"].eqNullSafe(F.get(F.col("__q_windows"), at + 1)["k"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        ),
    )
    # Each start covers the words up to the next start, a window at most.
    covered = F.when(
        F.size("__q_starts") > 0,
        F.aggregate(
            F.zip_with(F.slice("__q_starts", 2, F.size("__q_starts")), F.slice("__q_starts", 1, F.size("__q_starts") - 1), lambda b, a: F.least(F.lit(WINDOW), b - a)),
            F.lit(WINDOW).cast("long"),
            lambda s, x: s + x,
        ),
    )
    symbols = F.regexp_replace(text, r"[^#*$%&|<>]+", "")
    joined = F.array_join("__q_words", "")
    return (
        d.withColumn("q_word_chars", F.length(joined).cast("long"))
        .withColumn("q_n_symbols", F.length(symbols).cast("long"))
        .withColumn("q_n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
        .withColumn("q_n_lines", F.size("__q_lines").cast("long"))
        .withColumn("q_n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
        .withColumn("q_n_stop", F.size(F.filter("__q_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"))
        .withColumn("q_n_upper", F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long"))
        .withColumn("q_n_words", F.col("q_n_words").cast("long"))
        .drop(*STEPS)
        .withColumnsRenamed({new: c for c, new in aside.items()})
    )


def measures() -> dict[str, Column]:
    """The value of each rule from the counts."""
    n = F.col("q_n_words")
    return {
        "n_words": n.cast("double"),
        "mean_word_chars": _ratio(F.col("q_word_chars"), n),
        "symbol_ratio": _ratio(F.col("q_n_symbols"), n),
        "stop_ratio": _ratio(F.col("q_n_stop"), n),
        "dup_line_ratio": _ratio(F.col("q_n_dup_lines"), F.col("q_n_lines")),
        "repeat_ratio": _ratio(F.col("q_n_repeat_words"), n),
        "upper_ratio": _ratio(F.col("q_n_upper"), F.col("q_word_chars")),
    }


def verdict(rules: tuple[tuple[str, float | None, float | None], ...] = RULES) -> Column:
    """The rules' names that a document breaks, as one array expression."""
    value = measures()
    out = []
    for name, low, high in rules:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (value[name] < F.lit(float(low)))
        if high is not None:
            bad = bad | (value[name] > F.lit(float(high)))
        out.append(F.when(bad, F.lit(name)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def apply_rules(docs: DataFrame, rules: tuple[tuple[str, float | None, float | None], ...] = RULES) -> DataFrame:
    """``docs`` with the counts, q_base_failed, q_broken (names of broken rules) and q_kept."""
    base = (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words"))
    # A filter on q_kept would move below the projections and repeat their expressions; it doesn't move below inline().
    counted = quality_counts(docs)
    names = [c for c in counted.columns if c not in docs.columns or c in COUNTS]
    counted = counted.select(*(c for c in docs.columns if c not in COUNTS), F.inline(F.array(F.struct(*names))))
    return counted.withColumn("q_base_failed", base).withColumn("q_broken", verdict(rules)).withColumn("q_kept", ~F.col("q_base_failed") & (F.size("q_broken") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *(F.col(f"q_{n}").alias(n) for n in names))


def _broken_sql() -> str:
    """The conditions of RULES that break, in SQL."""
    ratio = lambda a, b: f"(CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"
    value = {
        "n_words": "CAST(n_words AS DOUBLE)", "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"), "stop_ratio": ratio("n_stop", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"), "upper_ratio": ratio("n_upper", "word_chars"),
    }
    sides = [f"{value[k]} {sign} {x}::DOUBLE" for k, low, high in RULES for sign, x in (("<", low), (">", high)) if x is not None]
    return " OR ".join(sides)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP9_SQL = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts
), windows AS (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM cut WHERE len(w) >= {WINDOW})
), starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS times FROM windows) WHERE times > 1),
covered AS (SELECT r, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM starts) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
  FROM cut LEFT JOIN covered USING (r)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_broken_sql()}) AS kept FROM judged
"""
