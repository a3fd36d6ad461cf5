"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import codec, decontaminate, exact, neardup, perplexity, secrets, substrings, token_files, toxicity, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_token_files": token_files.op2_token_files,
        "op3_exact_dedup": exact.op3_exact_dedup,
        "op4_secret_scan": secrets.op4_secret_scan,
        "op5_near_duplicates": neardup.op5_near_duplicates,
        "op6_quality": perplexity.op6_quality,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_repeated_strings": substrings.op8_repeated_strings,
        "op9_bpe_codec": codec.op9_bpe_codec,
        "op10_warc": warc.op10_warc,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontaminate.OP1_SQL,
        "op3_exact_dedup": exact.OP3_SQL,
        "op5_near_duplicates": neardup.OP5_SQL,
        "op10_warc": warc.OP10_SQL,
    }
