"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each line of ``RULES`` names a measure, the measure that it is a share of, and the least and most
per thousand of it that a text may have. ``compiled`` turns the table into Spark columns and ``compiled_sql`` into
the same conditions as text; all arithmetic is in whole numbers. Nothing runs in Python, and
no row leaves its partition: a text is split into an array of words, and its
repeated windows are found by sorting the hashes of its own windows.

Defined results: null and empty texts have no words, count 0 everywhere, and fail ``base``. Nothing but
the text counts; repeated rows each get their row, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

#: Function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that it for as with on be by at this from are was a an or not but have "
            "der die das und ist in zu den von mit auf für ein eine im dem sich nicht auch es als bei "
            "le la les de des du et en un une est que qui pour dans sur pas par au aux ce elle il avec "
            "el los las y que en un una es por con para su se del al no lo como más".split()
        )
    )
)

WINDOW = 8
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: (rule, measure, of which measure, least per thousand, most per thousand); None: no bound.
RULES: tuple[tuple[str, str, str, int | None, int | None], ...] = (
    ("word_length", "word_chars", "n_words", 2000, 14000),
    ("symbols", "n_symbols", "n_words", None, 100),
    ("stop_words", "n_stop_words", "n_words", 20, None),
    ("upper_case", "n_upper", "word_chars", None, 400),
    ("dup_lines", "n_dup_lines", "n_lines", None, 500),
    ("listed_lines", "n_listed_lines", "n_lines", None, 900),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of its texts as further columns, named as in the table with ``_m_`` before."""
    filled = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    split = filled.select(
        *docs.columns,
        "_text",
        F.filter(F.split("_text", WHITE), lambda w: w != "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = split.select(
        *docs.columns,
        F.size("_words").cast("long").alias("_m_n_words"),
        F.char_length(F.regexp_replace("_text", WHITE, "")).cast("long").alias("_m_word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("_m_n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("_m_n_upper"),
        F.size("_lines").cast("long").alias("_m_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_m_n_dup_lines"),
        F.size(F.filter("_lines", lambda line: line.rlike(r"^[\x20\x09-\x0D]*([-*#|>•]|[0-9]+[.)])"))).cast("long").alias("_m_n_listed_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("_m_n_stop_words"),
        F.transform(
            F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(1), F.greatest(F.size("_words") - WINDOW + 1, F.lit(1)))).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.slice("_words", i, WINDOW)),
        ).alias("_windows"),
    )
    # Only a text with a repeated window is sorted.
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    kept = [c for c in counted.columns if c != "_windows"]
    ordered = counted.select(
        *kept,
        F.when(some, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_order"),
    )
    last = F.size("_order") - 1
    repeated = ordered.select(
        *kept,
        F.array_sort(
            F.transform(
                F.filter("_order", lambda x, i: ((i > 0) & (F.get("_order", i - 1)["h"] == x["h"])) | ((i < last) & (F.get("_order", i + 1)["h"] == x["h"]))),
                lambda x: x["i"],
            )
        ).alias("_at"),
    )
    return repeated.select(
        *kept,
        F.aggregate(
            F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW))).cast("long")),
            F.lit(0).cast("long"),
            lambda a, b: a + b,
        ).alias("_m_n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("_m_n_words") < 20) | (100 * F.col("_m_n_repeat_words") > 30 * F.col("_m_n_words"))


def compiled(rules: tuple = RULES) -> dict[str, Column]:
    """A column for each rule that is true where the text breaks it."""
    out = {}
    for name, part, whole, least, most in rules:
        broken = F.lit(False)
        if least is not None:
            broken |= 1000 * F.col(f"_m_{part}") < least * F.col(f"_m_{whole}")
        if most is not None:
            broken |= 1000 * F.col(f"_m_{part}") > most * F.col(f"_m_{whole}")
        out[name] = broken
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple = RULES) -> DataFrame:
    """docs with its measures, base_failed, broken (array of rule names) and kept."""
    measured = measures(docs, text)
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in compiled(rules).items()]), lambda x: x.isNotNull())
    return measured.withColumn("base_failed", base_failed()).withColumn("broken", broken).withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures, the base verdict and the table's verdict."""
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *[F.col(f"_m_{n}").alias(n) for n in names], "base_failed", "kept", F.array_join("broken", ",").alias("broken_rules"))


def compiled_sql(rules: tuple = RULES) -> dict[str, str]:
    out = {}
    for name, part, whole, least, most in rules:
        parts = [f"1000 * {part} < {least} * {whole}"] * (least is not None) + [f"1000 * {part} > {most} * {whole}"] * (most is not None)
        out[name] = " OR ".join(parts)
    return out


_CONDITIONS = compiled_sql()
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT r, doc_id, t,
         list_filter(regexp_split_to_array(t, '{WHITE}'), lambda w: w <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), wins AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') AS s
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM s WHERE len(words) >= {WINDOW})
), dups AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM wins) WHERE c >= 2
), cover AS (
  SELECT r, sum(k) AS n FROM (
    SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS k FROM dups
  ) GROUP BY r
), m AS (
  SELECT s.r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{WHITE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*([-*#|>•]|[0-9]+[.)])'))) AS n_listed_lines,
         len(list_filter(words, lambda w: lower(w) IN ({_STOPS}))) AS n_stop_words,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN cover ON s.r = cover.r
), v AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
         concat_ws(',', {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CONDITIONS.items())}) AS broken_rules
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND broken_rules = '') AS kept, broken_rules
FROM v
"""
