"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lantern.llm.bpe import op11_byte_bpe
from lantern.llm.decontam import OP10_SQL, op10_decontamination
from lantern.llm.linededup import op5_line_dedup
from lantern.llm.ngram import op4_kneser_ney
from lantern.llm.packing import op3_best_fit_packing
from lantern.llm.pii import op9_pii
from lantern.llm.quality import OP7_SQL, op7_quality_rules
from lantern.llm.simhash import op6_simhash_near_dedup
from lantern.llm.toxicity import op2_toxicity
from lantern.llm.urls import op8_url_filters
from lantern.llm.variants import op13_spelling_variants
from lantern.llm.warc import OP1_SQL, op1_warc_zstd
from lantern.llm.whitening import op12_embedding_whitening

_ALL = (op1_warc_zstd, op2_toxicity, op3_best_fit_packing, op4_kneser_ney, op5_line_dedup, op6_simhash_near_dedup, op7_quality_rules, op8_url_filters, op9_pii, op10_decontamination, op11_byte_bpe, op12_embedding_whitening, op13_spelling_variants)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_zstd": OP1_SQL, "op7_quality_rules": OP7_SQL, "op10_decontamination": OP10_SQL}
