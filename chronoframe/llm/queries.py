"""The registered queries of the training-data operators."""

from __future__ import annotations

import importlib.util
import os

from chronoframe.llm.common import documents


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's vocabulary on this machine."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name)


def op1_media(spark, sf_dir):
    from chronoframe.llm import media

    return media.text_media(documents(spark, sf_dir))


def op2_langid(spark, sf_dir):
    from chronoframe.llm import langid

    return langid.identify(documents(spark, sf_dir))


def op3_suffix_array(spark, sf_dir):
    from chronoframe.llm import column_bwt

    return column_bwt.digests(documents(spark, sf_dir))


def op4_brown(spark, sf_dir):
    from chronoframe.llm import brown

    return brown.score(documents(spark, sf_dir))


def op5_bpe(spark, sf_dir):
    from chronoframe.llm import bpe

    return bpe.round_trip(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op6_simhash(spark, sf_dir):
    from chronoframe.llm import simhash

    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_embeddings(spark, sf_dir):
    from chronoframe.llm import pca_join

    return pca_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_suffix_trees(spark, sf_dir):
    from chronoframe.llm import suffix_trees

    return suffix_trees.digests(documents(spark, sf_dir))


def op9_packing(spark, sf_dir):
    from chronoframe.llm import packing

    return packing.pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op10_secrets(spark, sf_dir):
    from chronoframe.llm import secrets_markov

    return secrets_markov.report(documents(spark, sf_dir))


def queries():
    return {
        "op1_media": op1_media,
        "op2_langid": op2_langid,
        "op3_suffix_array": op3_suffix_array,
        "op4_brown": op4_brown,
        "op5_bpe": op5_bpe,
        "op6_simhash": op6_simhash,
        "op7_embeddings": op7_embeddings,
        "op8_suffix_trees": op8_suffix_trees,
        "op9_packing": op9_packing,
        "op10_secrets": op10_secrets,
    }


def oracle_sql():
    return {}
