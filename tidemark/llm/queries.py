"""The text queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import item_text
from tidemark.llm.cooccurrence import far_from_chance, frequent_pairs
from tidemark.llm.leakage import leaked_items, leaked_spans
from tidemark.llm.quality import COUNTS, stated_rule, text_counts, text_types
from tidemark.llm.tokenize import decoded_digest, token_ids
from tidemark.sources.tables import table

TIMES_CHANCE = 3

# 4. Items that appear together


def _tag_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_pairs(table(spark, folder, "event_records"), "id", "tags", item_text(F.col("item")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return far_from_chance(_tag_pairs(spark, folder), TIMES_CHANCE).select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _tag_pairs(spark, folder).withColumnsRenamed({"a": "tag_a", "b": "tag_b"})


_PAIRS_SQL = """
WITH t AS (SELECT DISTINCT id, lower(trim(u.tag, ' ')) AS tag FROM event_records, unnest(tags) AS u(tag)
           WHERE id IS NOT NULL AND trim(u.tag, ' ') <> ''),
     c AS (SELECT tag, count(*) AS k FROM t GROUP BY 1),
     n AS (SELECT count(DISTINCT id) AS n FROM t),
     p AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM t a JOIN t b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2),
     s AS (SELECT tag_a, tag_b, n_ab, x.k AS n_a, y.k AS n_b, n
           FROM p JOIN c x ON x.tag = tag_a JOIN c y ON y.tag = tag_b, n WHERE n_ab >= 5 AND n_ab * 500 >= n)
"""

# 8. Encoding of the whole corpus with a public tokenizer


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(table(spark, folder, "documents"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Size and digest of what the ids of each document decode to."""
    return decoded_digest(token_ids(table(spark, folder, "documents")))


# 9. Evaluation texts leaking into training text


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_spans(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_spans(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


# 10. Per-document text quality statistics


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the learnt type not_prose, of which the exact rule then keeps those that its thresholds call so; it can lose none by that."""
    typed = text_types(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    return typed.where(F.col("text_type") == "not_prose").where(stated_rule()).select("doc_id").distinct()


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    return text_counts(table(spark, folder, "documents"), table(spark, folder, "common_words")).select("doc_id", *COUNTS)


def p10_types(spark: SparkSession, folder: str) -> DataFrame:
    typed = text_types(table(spark, folder, "documents"), table(spark, folder, "common_words"))
    return typed.select("doc_id", *COUNTS, F.round("p_not_prose", 6).alias("p_not_prose"), "text_type")


_PUNCT = r"""[!-/:-@\[-`{-~]"""
_QUALITY_SQL = rf"""
WITH c AS (SELECT list(DISTINCT word) AS known FROM common_words WHERE word IS NOT NULL),
     w AS (SELECT doc_id, coalesce(text, '') AS text,
                  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda x: x <> '') AS words,
                  list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
                      lambda l: regexp_replace(l, '[ \t\r]+$', '')), lambda l: l <> '') AS lines FROM documents),
     s AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS n_chars,
                  length(text) - length(regexp_replace(text, '{_PUNCT}', '', 'g')) AS n_symbols,
                  len(list_filter(words, lambda x: list_contains(known,
                      lower(regexp_replace(regexp_replace(x, '^{_PUNCT}+', ''), '{_PUNCT}+$', ''))))) AS n_common,
                  len(lines) AS n_lines, len(list_filter(lines, lambda l: right(l, 1) IN ('.', '!', '?'))) AS n_ended
           FROM w, c)
""".replace(r"\t", "\t").replace(r"\n", "\n").replace(r"\r", "\r")

QUERIES = {
    f.__name__: f for f in (p4_found, p4_pairs, p8_ids, p8_roundtrip, p9_found, p9_spans, p10_found, p10_stats, p10_types)
}

SQL = {
    "p4_found": f"{_PAIRS_SQL} SELECT tag_a, tag_b FROM s WHERE n_ab * n >= {TIMES_CHANCE} * n_a * n_b",
    "p4_pairs": f"""{_PAIRS_SQL} SELECT tag_a, tag_b, n_ab, n_a, n_b, n,
        CAST(n_ab AS DOUBLE) * n / (CAST(n_a AS DOUBLE) * n_b) AS lift,
        CASE WHEN n_ab < n_a THEN (1 - CAST(n_b AS DOUBLE) / n) / (1 - CAST(n_ab AS DOUBLE) / n_a) END AS conviction FROM s""",
    "p8_roundtrip": """SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS md5
        FROM documents""",
    "p10_found": f"""{_QUALITY_SQL} SELECT doc_id FROM s WHERE n_words > 0 AND (n_chars >= 10 * n_words OR 4 * n_symbols >= n_chars
        OR (100 * n_common < 15 * n_words AND 5 * n_ended < n_lines))""",
    "p10_stats": f"""{_QUALITY_SQL} SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, n_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
        CAST(n_common AS BIGINT) AS n_common, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_ended AS BIGINT) AS n_ended FROM s""",
}
