"""Queries in SQL over the registered table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scholiast.functions import text as T
from scholiast.functions.tables import register
from scholiast.plans.registry import ORACLES, query, table

import scholiast.plans.texts  # noqa: F401, I001  for the oracle of the chunks


def _sql(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    register(spark)
    return spark.sql(text, rows=table(spark, sf_dir, name))


@query(ORACLES["chunk_documents"])
def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-08, STR-01: the chunker as a table function"""
    return _sql(spark, sf_dir, "documents", "SELECT doc_id, position, md5(chunk) AS chunk FROM chunks(TABLE(SELECT doc_id, text FROM {rows}), 'text')")


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_GUARDED = rf"regexp_replace({_FLAT}, '(?i)(^|[^\p{{L}}\p{{N}}_])({T.ABBREVIATIONS})\.', '\1\2' || chr(8291), 'g')"
_CUT = rf"""list_transform(string_split(regexp_replace({_GUARDED}, '([.!?])["'')\]]*\s+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(replace(x, chr(8291), '.')))"""


@query(rf"""WITH s AS (SELECT item_id, list_filter({_CUT}, lambda x: len(regexp_extract_all(x, '\S+')) >= 4) AS s FROM benchmark) SELECT item_id, unnest(range(len(s)))::INT AS number, unnest(s) AS sentence FROM s""")
def sql_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-08, STR-25: sentences of whole texts as a table function"""
    return _sql(spark, sf_dir, "benchmark", "SELECT item_id, number, sentence FROM sentences_of(TABLE(SELECT item_id, text FROM {rows}), 'text')")


@query("""WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) SELECT source, doc_id, used FROM r WHERE used <= 100000""")
def sql_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-08, WIN-06: a fold over partitions in order; what is behind the budget isn't read"""
    return _sql(spark, sf_dir, "documents", "SELECT source, doc_id, used FROM first_within(TABLE(SELECT source, doc_id, n_chars FROM {rows}) PARTITION BY source ORDER BY (n_chars DESC, doc_id), 'n_chars', 100000)")
