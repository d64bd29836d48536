"""Queries of the text operators, and the SQL that DuckDB can check them by."""

from __future__ import annotations

from feefloor.llm.bestfit_packing import op3_bestfit_packing
from feefloor.llm.decontaminate import op9_decontaminate
from feefloor.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from feefloor.llm.html_wrappers import op6_html_text
from feefloor.llm.jaccard_join import op8_jaccard_join
from feefloor.llm.permutation_index import op12_permutation_index
from feefloor.llm.quality_rules import OP1_SQL, op1_quality_rules
from feefloor.llm.secret_scan import op4_secret_scan
from feefloor.llm.source_divergence import OP11_SQL, op11_source_divergence
from feefloor.llm.suffix_dedup import op2_suffix_dedup
from feefloor.llm.token_counts import op5_token_counts
from feefloor.llm.toxicity import op10_toxicity
from feefloor.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_bestfit_packing": op3_bestfit_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_token_counts": op5_token_counts,
    "op6_html_text": op6_html_text,
    "op7_warc": op7_warc,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_permutation_index": op12_permutation_index,
    "op13_hard_negatives": op13_hard_negatives,
}

SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op7_warc": OP7_SQL,
    "op11_source_divergence": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
