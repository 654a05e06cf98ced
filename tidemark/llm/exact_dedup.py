"""Exact duplicates: a Bloom filter finds hashes that may be repeated, and only their rows are shuffled.

Texts are equal when they are so without their white space. All of it is DataFrame code; no Python runs.

1. One scan of the texts makes a narrow table (key, digest and hash of the normalised text, length, row number), which is written.
2. A Bloom filter, one bit for each hash in words of 64 bits, has ``WORDS_PER_ROW`` words for each row, so it is as sharp for any number of rows. A word that
   holds more rows than bits has a bit that was set twice; its bits are the second filter, of hashes that may be repeated. What sets a bit alone
   can't have an equal.
3. Rows outside the second filter pass as they are. The rest are grouped by digest: groups are reduced in the tasks before they are shuffled, and
   the rows get their group's result by a join. A key with more than one row in ``HEAVY`` of all goes to that join by broadcast (there
   are at most HEAVY of them), so no task gets a large group.

The second filter is broadcast while it has at most ``BROADCAST_WORDS`` words, and joined by word otherwise, in the same two parts.

Defined results: null counts as empty text; empty texts and those of nothing but white space equal each other. Of equal texts the one of most code points in the original stays,
then the least key, a null key last; rows that repeat key and text are judged by their place, so one stays and the others go. An empty table stays empty. Other columns aren't read by
``marked``; ``deduplicated`` keeps them as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
#: Words of 64 bits of the first filter for each row, before rounding up to a power of two.
WORDS_PER_ROW = 16
#: The second filter is broadcast up to so many words (24 bytes each, some 50 MB with the table that holds them).
BROADCAST_WORDS = 1 << 20
#: A key with more than one in so many of all rows is heavy; there can't be more of these.
HEAVY = 2048


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), WHITE, F.coalesce(text.cast("string"), F.lit("")))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: str | None = None) -> DataFrame:
    """key, hash, sha and chars of each row of docs, and all of its columns as one under the name of whole."""
    bare = docs.select(F.col(key).alias("key"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("chars"), normalised(F.col(text)).alias("bare"), *([F.struct("*").alias(whole)] if whole else []))
    return bare.select("key", F.xxhash64("bare").alias("hash"), F.sha2(F.col("bare").cast("binary"), 256).alias("sha"), "chars", *([whole] if whole else []))


def _place(words: int) -> tuple[Column, Column]:
    """The word of the filter that a hash falls on, and its bit there."""
    return F.col("hash").bitwiseAND(F.lit(words - 1)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned("hash", 58).cast("int"))


def repeated_words(rows: DataFrame, words: int) -> DataFrame:
    """word, bits, n: the words of the first filter that more rows fall on than they have bits, and how many rows that is."""
    word, bit = _place(words)
    found = rows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    return found.filter(F.col("n") > F.bit_count("bits"))


def _joined(rows: DataFrame, found: DataFrame, key: str, total: int, small: bool) -> DataFrame:
    """rows with the columns of found (key, n, others; null where there is no such key), which has a row for each key and its number of rows n.

    Small ones go to every task. Of others the heavy keys do, which are at most HEAVY, and rows of these are not shuffled."""
    if small:
        return rows.join(F.broadcast(found), key, "left")
    heavy = found.filter(F.col("n") * HEAVY > total)
    light = found.filter(F.col("n") * HEAVY <= total)
    by_broadcast = rows.join(F.broadcast(heavy), key)
    others = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return by_broadcast.unionByName(others.join(light, key, "left"))


@dataclass(frozen=True)
class Repeated:
    """The second filter: hashes that may be repeated, among total rows."""

    found: DataFrame
    words: int
    total: int
    small: bool


def repeated(rows: DataFrame) -> Repeated:
    """The second filter of rows (hash), written, so that its size is known and each later use starts from the files."""
    total = rows.count()
    words = 1 << max(total * WORDS_PER_ROW - 1, 1).bit_length()
    found = written(repeated_words(rows, words), "repeated")
    return Repeated(found, words, total, found.count() <= BROADCAST_WORDS)


def sifted(rows: DataFrame, second: Repeated) -> tuple[DataFrame, DataFrame]:
    """Of rows (hash, others) those that can't have an equal, and those that may have one."""
    word, bit = _place(second.words)
    tested = _joined(rows.withColumn("word", word).withColumn("bit", bit), second.found, "word", second.total, second.small)
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    return tested.filter(~maybe).select(*rows.columns), tested.filter(maybe).select(*rows.columns)


def groups(rows: DataFrame) -> DataFrame:
    """sha, stays_row, stays and chars (row number, key and length of the row that stays), n."""
    rank = F.struct((-F.col("chars")).alias("chars"), F.col("key").isNull().alias("none"), "key", "row")
    best = rows.groupBy("sha").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    return best.select("sha", F.col("best.row").alias("stays_row"), F.col("best.key").alias("stays"), (-F.col("best.chars")).alias("stays_chars"), "n")


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    second = repeated(rows)
    single, maybe = sifted(rows, second)
    grouped = _joined(maybe, written(groups(maybe), "groups"), "sha", second.total, False)
    names = F.col("key").alias(key), F.col("sha").alias("text_sha256")
    alone = single.select(*names, F.col("key").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(grouped.select(*names, F.col("stays").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("stays_row")).alias("kept")))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they are; of rows that repeat length and key too any one stays.

    The texts are read twice, and rows outside the second filter pass straight through the second time."""
    rows = written(digests(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "digests")
    second = repeated(rows)
    best = written(groups(sifted(rows, second)[1]), "groups")
    single, maybe = sifted(digests(docs, key, text, whole="doc"), second)
    ranked = _joined(maybe, best, "sha", second.total, False)
    first = ranked.filter(F.col("key").eqNullSafe(F.col("stays")) & (F.col("chars") == F.col("stays_chars"))).dropDuplicates(["sha"])
    return single.select("doc.*").unionByName(first.select("doc.*"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of its text that stays."""
    return marked(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS k
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, r)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM g
"""
