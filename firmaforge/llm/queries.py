"""The queries of this package and their SQL twins; importing it registers nothing elsewhere."""

from __future__ import annotations

import corpus_pipeline
from firmaforge.llm.audit import op11_filter_audit
from firmaforge.llm.bpe import op4_byte_bpe
from firmaforge.llm.chunks import op5_substring_dedup
from firmaforge.llm.decontaminate import op3_benchmark_decontamination
from firmaforge.llm.grades import op10_quality_classifier
from firmaforge.llm.language import op9_language_id
from firmaforge.llm.lines import op12_line_dedup
from firmaforge.llm.quality import op2_quality_rules
from firmaforge.llm.secrets import op8_secret_scans
from firmaforge.llm.simhash import op6_simhash_near_dedup
from firmaforge.llm.toxicity import op7_toxicity
from firmaforge.llm.twins import DECONTAMINATION, FILTER_AUDIT, LINE_DEDUP
from firmaforge.llm.whitening import op13_embedding_whitening
from firmaforge.llm.wrappers import op1_html_extraction

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scans": op8_secret_scans,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_dedup": op12_line_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": DECONTAMINATION,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_line_dedup": LINE_DEDUP,
}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
