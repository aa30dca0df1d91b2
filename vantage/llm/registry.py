"""The subpackage's queries, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP10_SQL, op10_preference_format
from .langid import op6_language_id
from .mixing import OP4_SQL, op4_pareto_mix
from .ngram_join import OP3_SQL, op3_ngram_join
from .packing import op2_best_fit_packing
from .pii import op13_personal_data
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_crf import op7_quality_crf
from .quality_rules import OP5_SQL, op5_line_rules
from .runs import OP12_SQL, op12_periodic_runs
from .secrets import op9_secret_scan
from .topk import OP8_SQL, op8_pivot_topk
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_pareto_mix": op4_pareto_mix,
    "op5_line_rules": op5_line_rules,
    "op6_language_id": op6_language_id,
    "op7_quality_crf": op7_quality_crf,
    "op8_pivot_topk": op8_pivot_topk,
    "op9_secret_scan": op9_secret_scan,
    "op10_preference_format": op10_preference_format,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}
ORACLES = {
    "op3_ngram_join": OP3_SQL,
    "op4_pareto_mix": OP4_SQL,
    "op5_line_rules": OP5_SQL,
    "op8_pivot_topk": OP8_SQL,
    "op10_preference_format": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
}
