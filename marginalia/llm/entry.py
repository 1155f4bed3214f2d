"""Queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

import corpus_pipeline
from marginalia.llm.byte_bpe import op9_byte_bpe
from marginalia.llm.decontaminate import op5_benchmark_decontamination
from marginalia.llm.filter_audit import op11_filter_audit
from marginalia.llm.language_id import op12_language_id
from marginalia.llm.minhash import op10_minhash
from marginalia.llm.oracle import ORACLE
from marginalia.llm.pii import op1_pii
from marginalia.llm.quality_model import op7_quality_classifier
from marginalia.llm.quality_rules import op3_quality_rules
from marginalia.llm.secrets import op4_secret_scans
from marginalia.llm.suffix_dedup import op8_suffix_dedup
from marginalia.llm.token_alignment import op13_token_alignment
from marginalia.llm.token_file import op6_token_files
from marginalia.llm.toxicity import op2_toxicity


def queries():
    own = {
        f.__name__: f
        for f in (
            op1_pii, op2_toxicity, op3_quality_rules, op4_secret_scans, op5_benchmark_decontamination, op6_token_files,
            op7_quality_classifier, op8_suffix_dedup, op9_byte_bpe, op10_minhash, op11_filter_audit, op12_language_id,
            op13_token_alignment,
        )
    }
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return ORACLE
