"""Corpus pipeline: junk out, near copies out, repeated passages cut, personal data masked, packed.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import jaccard, packing, pii, quality, substrings
from tallyloom.llm.common import aside, back, materialize, table


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """With n_chars, if there, made to fit the text again."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return back(quality.cascade(aside(docs)).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays; those without a doc_id stay.

    Near copies share at least 80 percent of their 5-word shingles; op7's 3 words and 90 percent bind only that query.
    Null and empty texts are like none.  Of rows that repeat a doc_id all stay, or none.  A long text is hashed by
    pieces, an empty table stays empty, and other columns, whatever their names, stay what they are."""
    classes = jaccard.jaccard_classes(docs.select("doc_id", "text"), least=80, shingle=5)
    others = classes.where("component_id <> doc_id").select("doc_id").distinct()
    return back(aside(docs).join(others, "doc_id", "left_anti"), docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that start in an earlier document go; documents of which nothing is left too.

    Texts that were null or blank before stay.  Repeated rows keep equal texts, long texts stream
    through as one row, an empty table stays empty, and other columns but n_chars stay what they are."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    cut = substrings.remove_repeats(aside(docs).withColumn("_had_words", worded))
    return _with_text(back(cut.where(worded | ~F.col("_had_words")), docs.columns), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans become their kind in brackets.

    Null texts stay null, texts without spans what they are; repeated rows are masked alike, a long text
    in one pass; an empty table stays empty, and other columns but n_chars stay what they are."""
    masked = pii.find(aside(docs)).withColumn("text", F.col("masked"))
    return _with_text(back(masked, docs.columns), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences; null and empty texts are an end id alone, repeated rows are packed as
    often as they occur, texts of more than 4096 tokens are cut, an empty table gives no pieces, and other columns are left out."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizing and packing can't be said in SQL; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
