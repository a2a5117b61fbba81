"""Filters, cleans and packs a corpus: each stage works on what its predecessor kept.

Rows with a null doc_id leave in the first stage; all stages but the last return the columns of documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from catchwater.llm.minhash import near_duplicates
from catchwater.llm.packing import pack
from catchwater.llm.rules import judge
from catchwater.llm.session import cut, table
from catchwater.llm.suffix import remove_repeats
from catchwater.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each row's content, for rows may share a doc_id; rows equal in both are equal in all that a stage looks at."""
    missing = (F.col(c).isNull() for c in COLUMNS[1:])
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS[1:], *missing).alias("row_key"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that pass the adaptive rules.

    Null and empty texts have no words and leave; of rows that share an id each is judged by its own text; ties between
    equal rows do not arise, as both stay or both leave. An empty table gives an empty table; other columns are left behind.
    """
    docs = _keyed(docs)
    kept = judge(docs, ("row_key",)).where("kept").select("doc_id", "row_key")
    return docs.join(kept, ["doc_id", "row_key"], "left_semi").select(*COLUMNS)


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that are not predicted toxic.

    Null and empty texts have no evidence and stay; of rows that share an id each is judged by its own text. An empty
    table gives an empty table; other columns are left behind.
    """
    docs = _keyed(docs)
    kept = toxicity(docs, table(spark, sf_dir, "labels"), more=("row_key",)).where("predicted = 0").select("doc_id", "row_key")
    return docs.join(kept, ["doc_id", "row_key"], "left_semi").select(*COLUMNS)


def _row_of_each_id(docs: DataFrame) -> DataFrame:
    """The row with the smallest key of each doc_id; texts are dealt anew only if ids repeat."""
    repeated = cut(_keyed(docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("row_key").alias("least")).where("n > 1").select("doc_id", "least"))
    if not repeated.limit(1).count():
        return docs
    return cut(_keyed(docs).join(repeated, "doc_id", "left").where("least is null or row_key = least").dropDuplicates(["doc_id"]).select(*COLUMNS))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and one row of each id.

    Null and empty texts are linked with nothing and stay. Of rows that share an id the one with the smallest key counts.
    An empty table gives an empty table; other columns are left behind.
    """
    docs = _row_of_each_id(docs)
    kept = near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of the texts; a character that a removed run covers only in part stays whole.

    One row for each row: null texts become empty, rows that share an id take nothing from each other, n_chars is counted
    anew. An empty table gives an empty table; other columns are left behind.
    """
    texts = remove_repeats(docs, as_text=True, more=("lang", "source")).withColumn("text", F.col("kept").cast("string"))
    return texts.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences, one row for each piece.

    A null text is an empty one, and an empty text is one token; a very long one is cut into pieces. Rows that repeat an id
    or a text are packed one by one; which of equally long pieces goes where is settled by a seeded order. An empty table
    gives no rows; other columns are left behind.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", clean_of_toxicity),
    ("near duplicates", one_of_each),
    ("repeated passages", without_repeats),
    ("packing", best_fit),
]

#: No stage's model or search can be said in SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
