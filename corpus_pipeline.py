"""A training-data pipeline: language, near-duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns is
written as Parquet and read again as the docs of the next. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import column_bwt, langid, packing, secrets_markov, simhash
from chronoframe.llm.common import Scratch, documents, numbered, renamed
from chronoframe.llm.queries import tokenizer_file

#: A document stays if its best language has at least this probability.
LEAST_SCORE = 0.5
#: Bytes of a repeated passage; 51 words of three letters have 203 (those of sf0.1 a median of 316).
PASSAGE_BYTES = 200


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told; the model is learned from the labelled rows of docs.

    Null texts and those without a letter go. Where no row is labelled there is nothing to
    tell languages by, and all stay. Repeated rows share their fate; an empty table stays empty.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs
    own, at = numbered(docs)
    found = langid.predict(own, model, at["text"])
    return found.where((found["lang_pred"] != langid.UNKNOWN) & (found["score"] >= LEAST_SCORE)).select(renamed(at))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose texts share four fifths of their shingles of five words.

    Null texts count as empty and all without words are alike; of rows that repeat one
    stays; a null id sorts first. An empty table stays empty.
    """
    return simhash.first_of_similar(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every passage of 200 bytes or more that stands earlier too, so those of more than 50 words of ordinary length.

    The first copy stays, by doc_id and place. Null texts stay null, no document goes, and
    an empty table stays empty; see column_bwt.remove for ties.
    """
    return column_bwt.remove(docs, PASSAGE_BYTES)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; null texts stay null, no document goes, and an empty table stays empty."""
    return secrets_markov.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token ids of what is left into sequences.

    Null texts count as empty and take one token; long ones are cut into pieces; rows that
    repeat are packed each; an empty table gives no rows.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language id", identify),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("secret scan", redact),
    ("best-fit packing", pack),
]

#: SQL cannot express the stages: the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = scratch.keep(docs)
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
