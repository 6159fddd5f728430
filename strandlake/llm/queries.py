"""The queries of this subpackage, and their SQL where SQL can express them."""

from .byte_bpe import op5_byte_bpe
from .filter_audit import OP11_SQL, op11_filter_audit
from .hmm import op10_hmm_scores
from .html_text import op3_html_text
from .jaccard import op6_ngram_jaccard
from .packing import op2_best_fit_packing
from .pfor import op8_pfor_tokens
from .quality import op12_quality_ranking
from .resampling import OP13_SQL, op13_target_resampling
from .suffixes import op7_suffix_dedup
from .toxicity import op4_toxicity
from .vectors import OP9_SQL, op1_vantage_ann, op9_pivot_top_k

QUERIES = {
    f.__name__: f
    for f in (op1_vantage_ann, op2_best_fit_packing, op3_html_text, op4_toxicity, op5_byte_bpe, op6_ngram_jaccard, op7_suffix_dedup, op8_pfor_tokens, op9_pivot_top_k, op10_hmm_scores, op11_filter_audit, op12_quality_ranking, op13_target_resampling)
}
SQL = {"op9_pivot_top_k": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_target_resampling": OP13_SQL}
