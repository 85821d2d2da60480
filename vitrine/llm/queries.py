"""Queries of the training-data problems over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import canonical, encoding, mixing, packing, residue, term_frequency, tokens
from vitrine.session import checkpointed
from vitrine.sources.tables import table

RARE_RECORDS, COMMON_SHARE = 2, 0.25
#: Total of p8_given_budget, in tokens of all documents.
GIVEN_BUDGET = 1


def _p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    captures = table(spark, folder, "captures")
    fields = {"keywords": (F.col("keywords.word"), F.col("keywords.n")), "offers": (F.col("offers"), None)}
    counts = term_frequency.term_counts(captures.select("keywords", "offers"), fields)
    return term_frequency.marked(counts, captures.agg(F.count(F.lit(1)).alias("n")), RARE_RECORDS, COMMON_SHARE)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p5_counts(spark, folder).filter("mark IS NOT NULL").select("field_name", "term", "mark")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _p5_counts(spark, folder)


P5_SQL = r"""
WITH t AS (
  SELECT capture_id, 'keywords' AS field_name, k.word AS term, k.n AS n FROM (SELECT capture_id, unnest(keywords) AS k FROM captures)
  UNION ALL SELECT capture_id, 'offers', o, 1 FROM (SELECT capture_id, unnest(offers) AS o FROM captures)),
u AS (SELECT capture_id, field_name, lower(trim(regexp_replace(term, '[\s\x{00A0}\x{2007}\x{202F}]+', ' ', 'g'))) AS term, coalesce(n, 0) AS n FROM t WHERE term IS NOT NULL),
c AS (SELECT field_name, term, CAST(sum(n) AS BIGINT) AS n_uses, count(DISTINCT capture_id) AS n_records FROM u WHERE term <> '' GROUP BY 1, 2)
SELECT field_name, term, n_uses, n_records, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.25 * (SELECT count(*) FROM captures) THEN 'common' END AS mark FROM c
"""


def _messages(spark: SparkSession, folder: str) -> DataFrame:
    fields = {c: F.col(c) for c in ("hero_message", "seo.title", "status")}
    return residue.messages(table(spark, folder, "captures"), "capture_id", "slug", fields)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.flagged_items(_messages(spark, folder)).withColumnRenamed("item", "capture_id")


def p3_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct messages that are no content, with how widely they recur."""
    return residue.recurrence(_messages(spark, folder))


def _brand_index(spark: SparkSession, folder: str) -> canonical.NgramIndex:
    return canonical.NgramIndex(canonical.reference_names(table(spark, folder, "brand_list"), "slug", "brand", "aliases"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    index = _brand_index(spark, folder)
    typed = canonical.map_names(table(spark, folder, "competitors"), "competitor_id", "name", index)
    named = canonical.find_mentions(table(spark, folder, "aio"), "answer_id", "answer_text", index)
    row = lambda df, src: df.select(F.lit(src).alias("src"), F.col("item").alias("row_id"), F.col("key").alias("slug"))
    return row(typed, "competitors").unionByName(row(named, "aio"))


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The typed values that mean no entry, with their frequency."""
    competitors = table(spark, folder, "competitors")
    found = canonical.map_names(competitors, "competitor_id", "name", _brand_index(spark, folder)).filter("key = 'unmatched'").select(F.col("item").alias("competitor_id"))
    return competitors.join(found, "competitor_id").groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


def _p7(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes, encoded once, and the limits with segments and loss for them."""
    docs = checkpointed(tokens.sized(table(spark, folder, "documents").select("doc_id", "text"), "text", loss=True))
    return docs, checkpointed(packing.limits_for(docs, table(spark, folder, "pack_limits")))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or part of an oversized one, with its container for each capacity."""
    docs, limits = _p7(spark, folder)
    return packing.pack(docs, "doc_id", limits).withColumnRenamed("item", "doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, for each of the three limits."""
    docs, limits = _p7(spark, folder)
    return packing.report(packing.pack(docs, "doc_id", limits), limits)


def _p8(spark: SparkSession, folder: str, budget: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix, its targets and its plan; documents are encoded once."""
    docs = checkpointed(tokens.sized(table(spark, folder, "documents").select("doc_id", "source", "text"), "text"))
    targets = table(spark, folder, "mix_targets")
    if budget is None:
        planned = mixing.plan_of(docs, "doc_id", "source", targets)
    else:
        total = docs.agg(F.sum("n_tokens")).first()[0] or 0
        planned = mixing.plan_of(docs, "doc_id", "source", targets, budget * total)
    return mixing.mix(docs, "doc_id", "source", targets, planned=planned), targets, planned


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in each mix, in the order of the mix; the budget is the largest at which all sources with documents meet their shares."""
    return _p8(spark, folder)[0].withColumnRenamed("item", "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(*_p8(spark, folder))


def p8_given_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The report of mixes whose total is given, GIVEN_BUDGET times the tokens of all documents: sources run out, the others take over, and what was missed is told."""
    return mixing.report(*_p8(spark, folder, GIVEN_BUDGET))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled_tokens(table(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.restored_texts(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p7_pack": p7_pack, "p7_report": p7_report, "p8_mix": p8_mix, "p8_report": p8_report, "p8_given_budget": p8_given_budget, "p9_found": p9_found, "p9_restored": p9_restored, "p3_found": p3_found, "p3_messages": p3_messages, "p5_found": p5_found, "p5_counts": p5_counts}
SQL = {"p5_found": f"SELECT field_name, term, mark FROM ({P5_SQL}) WHERE mark IS NOT NULL", "p5_counts": P5_SQL}
