"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .cube import cube_mix
from .decontaminate import contaminated
from .ledger import ABLATIONS as ABLATIONS_SQL
from .ledger import ORACLE as LEDGER_SQL
from .ledger import ablations, ledger, quality_verdicts
from .linedup import without_repeated_lines
from .minhash import ORACLE as NEAR_SQL
from .minhash import near_duplicates
from .prefixbpe import bpe_digests
from .pseudonyms import pseudonymised
from .rans import token_ids
from .resampling import ORACLE as RESAMPLED_SQL
from .resampling import resampled
from .rulefit import quality_scores
from .secrets import ORACLE as SECRETS_SQL
from .secrets import secret_spans
from .spelling import ORACLE as SPELLING_SQL
from .spelling import spelling_variants
from .wordpiece import byte_level_pieces, token_counts

Query = Callable[[SparkSession, str], DataFrame]


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix(table(spark, sf_dir, "documents"))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), KEY)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def ledger_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy rejects, and rejects alone."""
    return ablations(ledger(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "documents"))


def op6_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), byte_level_pieces(TOKENIZER))


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op9_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), RANKS)


#: A public byte-level BPE vocabulary, read from its package, and the same as ranks.
TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The key of the pseudonyms in the query; a user brings their own.
KEY = b"an example key"

QUERIES: dict[str, Query] = {
    "op1_cube_mix": op1_cube_mix,
    "op2_feistel_pseudonyms": op2_feistel_pseudonyms,
    "op3_decontamination": op3_decontamination,
    "op4_rule_ledger": op4_rule_ledger,
    "op5_line_dedup": op5_line_dedup,
    "op6_rule_ensemble": op6_rule_ensemble,
    "op7_longest_match_counts": op7_longest_match_counts,
    "op8_entropy_secrets": op8_entropy_secrets,
    "op9_rans_token_ids": op9_rans_token_ids,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_prefix_bpe": op13_prefix_bpe,
    "ledger_ablations": ledger_ablations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_rule_ledger": LEDGER_SQL,
    "ledger_ablations": ABLATIONS_SQL,
    "op8_entropy_secrets": SECRETS_SQL,
    "op10_minhash_near_dedup": NEAR_SQL,
    "op11_spelling_variants": SPELLING_SQL,
    "op12_importance_resampling": RESAMPLED_SQL,
}
