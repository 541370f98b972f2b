"""The operators' queries over whole tables, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from inkwell.llm.byte_bpe import op6_byte_bpe
from inkwell.llm.fingerprints import op9_fingerprints
from inkwell.llm.licenses import op5_licenses
from inkwell.llm.merkle import op12_merkle
from inkwell.llm.minhash import op7_minhash
from inkwell.llm.packing import op4_packing
from inkwell.llm.periodic import op13_periodic_runs
from inkwell.llm.quality import op8_quality_rules
from inkwell.llm.token_files import op3_token_files
from inkwell.llm.toxicity import op1_toxicity
from inkwell.llm.urls import op10_url_filter
from inkwell.llm.vector_search import op11_vector_search
from inkwell.llm.warc import op2_warc


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_warc": op2_warc,
        "op3_token_files": op3_token_files,
        "op4_packing": op4_packing,
        "op5_licenses": op5_licenses,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_minhash": op7_minhash,
        "op8_quality_rules": op8_quality_rules,
        "op9_fingerprints": op9_fingerprints,
        "op10_url_filter": op10_url_filter,
        "op11_vector_search": op11_vector_search,
        "op12_merkle": op12_merkle,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    from inkwell.llm import sql

    found = {"op2_warc": sql.OP2, "op5_licenses": sql.OP5, "op7_minhash": sql.OP7, "op8_quality_rules": sql.OP8, "op10_url_filter": sql.OP10}
    found |= {"op11_vector_search": sql.OP11, "op12_merkle": sql.OP12, "op13_periodic_runs": sql.OP13}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
