"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .cost_packing import op12_cost_balanced_packing
from .decontamination import OP2_SQL, op2_decontamination
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .license_scan import OP7_SQL, op7_license_scan
from .lm_scoring import op3_lm_scoring
from .near_dedup import op6_near_dedup
from .packing import op1_best_fit_packing
from .periodic_runs import OP13_SQL, op13_periodic_runs
from .quality import op10_quality_classifier
from .ranked_search import OP11_SQL, op11_ranked_search
from .substring_dedup import OP4_SQL, op4_substring_dedup
from .token_counts import WORDS_SQL, op9_token_counts, token_counts_words
from .url_filter import OP8_REDIRECTS_SQL, OP8_SQL, op8_url_filter, url_redirects

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "url_redirects": url_redirects,
    "op9_token_counts": op9_token_counts,
    "token_counts_words": token_counts_words,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ranked_search": op11_ranked_search,
    "op12_cost_balanced_packing": op12_cost_balanced_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op2_decontamination": OP2_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_license_scan": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "url_redirects": OP8_REDIRECTS_SQL,
    "token_counts_words": WORDS_SQL,
    "op11_ranked_search": OP11_SQL,
    "op13_periodic_runs": OP13_SQL,
}
