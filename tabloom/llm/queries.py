"""Registered queries of the operators, with their SQL where SQL can express them."""

import public_tokenizers

from tabloom.llm import (
    language_id, lm_scoring, mixing, packing, periodic_runs, quality_rules, secret_scan, simhash, spot_signatures, token_counts, token_files,
    url_filter, whitening,
)

QUERIES, SQL = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, directory, name):
    return spark.read.parquet(f"{directory}/{name}.parquet")


@query
def op1_token_counts(spark, directory):
    return token_counts.count_tokens(table(spark, directory, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_simhash_groups(spark, directory):
    return simhash.near_groups(table(spark, directory, "documents"))


@query
def op3_lm_scoring(spark, directory):
    return lm_scoring.score(table(spark, directory, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_url_filter(spark, directory):
    return url_filter.judge(table(spark, directory, "pages"))


@query
def op5_best_fit_packing(spark, directory):
    return packing.pack(table(spark, directory, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_secret_scan(spark, directory):
    return secret_scan.secret_report(table(spark, directory, "documents"))


@query
def op9_quality_rules(spark, directory):
    return quality_rules.judge(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query
def op7_language_id(spark, directory):
    return language_id.identify(table(spark, directory, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_mixing(spark, directory):
    return mixing.mixed(table(spark, directory, "documents"))


SQL["op8_mixing"] = mixing.mixed_sql()


@query
def op10_spot_signatures(spark, directory):
    return spot_signatures.edited_report(table(spark, directory, "documents"))


@query
def op12_periodic_runs(spark, directory):
    return periodic_runs.find_runs(table(spark, directory, "documents"), prepare=periodic_runs.planted)


@query
def op13_embedding_whitening(spark, directory):
    return whitening.whiten(table(spark, directory, "embeddings"))


@query
def op11_token_files(spark, directory):
    return token_files.round_trip(table(spark, directory, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
