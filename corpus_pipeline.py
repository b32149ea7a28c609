"""Corpus cleaning as a chain of stages; each is written as Parquet and read again as the documents of the next.

All stages but the last return the columns of the documents they get. Documents that language identification does not
recognise go; of each group of near copies one document stays; word sequences that occur earlier are cut out, and
documents left without words go; documents that overlap a benchmark item go; what remains is encoded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factbase.llm import bpe, decontaminate, language, ngram_join, substrings
from factbase.llm.queries import op10_columns, table
from factbase.llm.storage import shared

LEAST_SCORE = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the columns __0, __1, .., which no operator's own columns clash with."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language: not `und`, and a posterior probability of LEAST_SCORE or more."""
    model = language.fit(docs)
    rows, names = _numbered(docs)
    known = language.predict(rows, model, keep=names, text=names[docs.columns.index("text")])
    return known.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*names).toDF(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies."""
    return ngram_join.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated 20-word sequences; those that lose all their words go."""
    rows, names = _numbered(docs)
    at = {c: n for c, n in zip(docs.columns, names)}
    found = substrings.remove_repeats(rows, keep=[n for n in names if n != at["text"]], id_col=at["doc_id"], text=at["text"], as_is=True)
    found = found.where("n_removed = 0 or n_removed < n_words").withColumn(at["text"], F.col("kept"))
    if "n_chars" in at:
        chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(at["n_chars"]))
        found = found.withColumn(at["n_chars"], chars.cast(docs.schema["n_chars"].dataType))
    return found.select(*names).toDF(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    rows, names = _numbered(docs)
    found = decontaminate.find_overlaps(rows, table(spark, sf_dir, "benchmark"), keep=names, text=names[docs.columns.index("text")])
    return found.where(F.size("matches") == 0).select(*names).toDF(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each document, as digests."""
    import public_tokenizers
    return op10_columns(bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("ngram_jaccard", ngram_jaccard), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("bpe_encoding", bpe_encoding)]
ORACLE_SQL = None  # SQL has no tokenizer; tests hold the chain against plain versions of all stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
