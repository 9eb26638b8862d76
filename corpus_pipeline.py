"""A corpus pipeline over documents: quality rules, language ID, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and its result is written as Parquet
and read again as the next one's ``docs``. The first three filter: they return the columns of their input. The last returns
the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import hd_langid, packing, rule_ledger, shingle_join
from quillgrid.llm.shared import shared_folder
from quillgrid.shipping import ship

#: Language scores are cosines put from -1..1 to 0..1; below this a text is like no language that was learned.
LEAST_LANGUAGE_SCORE = 0.6
#: Documents are near copies if they share four fifths of their distinct five-word shingles.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy 3 of the rule ledger keeps: a repeated line or two rejects nothing. Null and empty texts go; repeated
    rows are judged each; an empty table stays empty; all columns are kept, whatever their names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    kept = rule_ledger.apply_policy(rule_ledger.measure(rows, rules=rule_ledger.ALL_RULES), 3, rule_ledger.ALL_RULES)
    return kept.filter("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus teaches; those without letters, or like none, go. So do null texts, and all where no
    row has a lang; repeated rows are judged each; an empty table stays empty; all columns are kept."""
    ship(spark)
    lang = hd_langid.language_column(docs)
    return docs.filter((lang["lang"] != hd_langid.UNKNOWN) & (lang["score"] >= LEAST_LANGUAGE_SCORE))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id. The SimHash grid proposes near copies, each is
    checked by its shingles, and a prefix filter completes the groups: no fingerprint distance keeps all pairs of this similarity.
    Null doc_ids come last in a group, null and empty texts are one group, an empty table stays empty, all columns are kept."""
    ship(spark)
    return shingle_join.representatives(docs, words=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of 1024 tokens. A null or empty text is the end id alone; repeated
    rows are packed each; an empty table gives an empty result; other columns are left out."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_dedup),
    ("best-fit packing", best_fit_packing),
]

#: None: the language, near-dedup and packing stages can't be written in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last goes through a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = shared_folder(spark, f"pipeline-{n}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
