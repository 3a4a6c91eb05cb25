"""From raw documents to packed training sequences, in five stages.

Each stage works on all rows its predecessor kept, and all but the last return the columns of
documents. Extra columns pass through.
"""

import public_tokenizers

from tabloom.llm import mixing, near_copies, packing, quality_rules, secret_scan
from tabloom.llm.common import stored


def quality(spark, docs, sf_dir):
    """Documents that the learned decision list rejects go."""
    return quality_rules.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return near_copies.one_of_each(docs)


def secrets(spark, docs, sf_dir):
    """Every secret is masked in its text; n_chars follows."""
    return secret_scan.redact(docs)


def mixing_weights(spark, docs, sf_dir):
    """Documents are drawn so that sources, languages and topics meet their targets."""
    return mixing.sample(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Token pieces with their place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("mixing", mixing_weights),
    ("best_fit_packing", best_fit_packing),
]

#: A learned list, hashed fingerprints and a tokenizer are beyond SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
