"""Quality rules: word and line statistics, and lines that many documents of a host share.

Only DataFrame functions: text is split and hashed in the row, and one shuffle
of (host, line hash, text hash) counts the documents of a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import SPACE_GAP, SPACE_WORD, ascii_lower, sql_ascii_lower, table

SYMBOLS = r"[#*$%&|<>]"
#: A line is dropped from its host's documents beyond so many different texts.
MAX_TEXTS = 20
#: A document that loses more than this share of its words, or is left with fewer than 50, is depleted.
MAX_LOST = 50
MIN_WORDS = 50


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_GAP), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE_WORD))


def line_hash(line: Column) -> Column:
    """Of the line in lower case, gaps as single blanks, none at the ends."""
    return F.xxhash64(F.trim(F.regexp_replace(ascii_lower(line), SPACE_GAP, " ")))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text.

    Windows are sorted by hash with their place in the low bits; equal
    neighbours (full hashes compared) give the places, whose gaps give the
    words: linear but for the sort, however long the text.
    """

    def from_hashes(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h)))
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        place = lambda x: x.bitwiseAND(mask)
        full = lambda x: F.get(h, place(x).cast("int"))
        packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", x, bits).bitwiseOR(i.cast("long"))))

        def places(p: Column) -> Column:
            near = lambda x, j: F.coalesce(full(x) == full(F.get(p, j)), F.lit(False))
            hit = F.transform(p, lambda x, j: F.when(near(x, j - 1) | near(x, j + 1), place(x)).otherwise(F.lit(-1).cast("long")))
            return F.sort_array(F.filter(hit, lambda x: x >= 0))

        def covered(at: Column) -> Column:
            steps = F.transform(at, lambda x, j: F.coalesce(F.least(F.get(at, j + 1) - x, F.lit(3).cast("long")), F.lit(3).cast("long")))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(packed, lambda p: let(places(p), covered)))

    def from_words(w: Column) -> Column:
        n = F.size(w)
        hashes = F.transform(F.slice(w, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(hashes, from_hashes))

    return let(words, from_words)


def statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    body = F.coalesce(text, F.lit(""))
    both = let(words_of(body), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    lines = let(lines_of(body), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return {"_words": both, "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"), "n_dup_lines": lines}


def frequent_lines(docs: DataFrame, max_texts: int) -> DataFrame:
    """(_host, _line, _first): lines in more than ``max_texts`` different texts of a host, and the smallest id that has them.

    ``docs`` has _doc, _host, _text_hash, _lines (distinct hashes).  Copies of a
    text count once, so a copied document is not taken for boilerplate.
    """
    each = docs.select("_doc", "_host", "_text_hash", F.explode("_lines").alias("_line"))
    texts = each.groupBy("_host", "_line", "_text_hash").agg(F.min("_doc").alias("_doc"))
    return texts.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"), F.min("_doc").alias("_first")).filter(
        F.col("_n") > max_texts).drop("_n")


def judged(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_texts: int = MAX_TEXTS,
    max_lost: int = MAX_LOST, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: id, the statistics, n_frequent_words, base_failed, kept, and ``carry``.

    A line in more than ``max_texts`` different texts of a host is removed from
    that host's documents, but for the one with the smallest id.  A document is
    rejected if its statistics fail, or if it is depleted: it loses words and
    more than ``max_lost`` percent of them, or is left with fewer than 50.

    Null, empty and blank texts: zeros, base_failed.  A null host is a host of
    its own; a row with a null id never is the one that keeps a line.  Repeated
    rows get equal results and count as one text.  Other columns, whatever
    their names, are ignored unless carried.  No rows give no rows.
    Carried columns come back as _carry.name; _removed holds the hashes of
    removed lines.
    """
    body = F.col(text)
    base = docs.select(
        F.col(doc_id).alias("_doc"), F.col(host).cast("string").alias("_host"), body.alias("_text"),
        F.xxhash64(F.coalesce(body, F.lit(""))).alias("_text_hash"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    lines = base.select("_doc", "_host", "_text_hash", F.transform(
        lines_of(F.coalesce("_text", F.lit(""))), line_hash).alias("_all"))
    lines = lines.withColumn("_lines", F.array_distinct("_all"))
    often = frequent_lines(lines, max_texts)
    removed = lines.select("_doc", "_host", "_text_hash", F.explode("_lines").alias("_line")).join(
        often.select(F.col("_host").alias("_h"), F.col("_line").alias("_l"), "_first"),
        F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_line") == F.col("_l"))).filter(
        ~F.col("_doc").eqNullSafe(F.col("_first"))).groupBy("_doc", "_host", "_text_hash").agg(
        F.collect_set("_line").alias("_removed")).select(
        F.col("_doc").alias("_d"), F.col("_host").alias("_h"), F.col("_text_hash").alias("_t"), "_removed")
    counted = F.transform(lines_of(F.coalesce("_text", F.lit(""))), lambda x: F.struct(
        line_hash(x).alias("h"), F.size(words_of(x)).cast("long").alias("n")))
    stats = base.select("_doc", "_host", "_text_hash", "_carry", *[c.alias(k) for k, c in statistics(F.col("_text")).items()], counted.alias("_lines"))
    out = stats.join(removed, F.col("_doc").eqNullSafe(F.col("_d")) & F.col("_host").eqNullSafe(F.col("_h")) & (
        F.col("_text_hash") == F.col("_t")), "left")
    lost = F.when(F.col("_removed").isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(
        F.filter("_lines", lambda x: F.array_contains("_removed", x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    n, again = F.col("_words.n_words"), F.col("_words.n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * again > 50 * n)
    out = out.select("*", lost.alias("n_frequent_words"), failed.alias("base_failed"))
    gone = F.col("n_frequent_words")
    depleted = (gone > 0) & ((100 * gone > max_lost * n) | (n - gone < MIN_WORDS))
    return out.select(
        F.col("_doc").alias(doc_id), n.alias("n_words"), F.col("_words.word_chars").alias("word_chars"), "n_symbols", "n_dup_lines",
        again.alias("n_repeat_words"), "n_frequent_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"),
        "_removed", "_carry")


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in ``removed``; other lines stay as they are."""
    rest = F.filter(F.split(text, "\n"), lambda x: ~(x.rlike(SPACE_WORD) & F.array_contains(removed, line_hash(x))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(rest, "\n"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("_removed", "_carry")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACE_WORD}')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), unnest([i, i + 1, i + 2]) AS v(p)
      WHERE c > 1 GROUP BY 1),
ln AS (SELECT doc_id, source, t, len(regexp_extract_all(x, '{SPACE_WORD}')) AS n,
              trim(regexp_replace({sql_ascii_lower("x")}, '{SPACE_GAP}', ' ', 'g'), ' ') AS x FROM d, unnest(l) AS u(x)),
o AS (SELECT source, x, min(doc_id) AS f FROM ln GROUP BY 1, 2 HAVING count(DISTINCT t) > {MAX_TEXTS}),
lost AS (SELECT doc_id, CAST(sum(ln.n) AS BIGINT) AS n FROM ln JOIN o ON ln.source IS NOT DISTINCT FROM o.source AND ln.x = o.x AND doc_id <> f GROUP BY 1),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '{SYMBOLS}')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost.n, 0) AS n_frequent_words
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND NOT (n_frequent_words > 0 AND (100 * n_frequent_words > {MAX_LOST} * n_words OR n_words - n_frequent_words < {MIN_WORDS})) AS kept
FROM f
"""
