"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from edgecraft.llm.bpe_lexicon import op6_bpe_lexicon
from edgecraft.llm.chat_format import OP13_SQL, op13_chat_format
from edgecraft.llm.katz import op9_katz_backoff
from edgecraft.llm.langid import op10_language_id
from edgecraft.llm.order_minhash import op7_order_minhash
from edgecraft.llm.packing import op8_best_fit_packing
from edgecraft.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from edgecraft.llm.secrets import op4_secret_scan
from edgecraft.llm.shingle_join import OP5_SQL, op5_shingle_join
from edgecraft.llm.source_audit import OP12_SQL, op12_source_audit
from edgecraft.llm.token_cache import op3_token_counts
from edgecraft.llm.toxicity import op2_toxicity
from edgecraft.llm.voronoi_knn import OP1_SQL, op1_voronoi_knn

QUERIES = {
    "op1_voronoi_knn": op1_voronoi_knn,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_secret_scan": op4_secret_scan,
    "op5_shingle_join": op5_shingle_join,
    "op6_bpe_lexicon": op6_bpe_lexicon,
    "op7_order_minhash": op7_order_minhash,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_katz_backoff": op9_katz_backoff,
    "op10_language_id": op10_language_id,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_audit": op12_source_audit,
    "op13_chat_format": op13_chat_format,
}
ORACLES = {"op1_voronoi_knn": OP1_SQL, "op5_shingle_join": OP5_SQL,
           "op11_periodic_runs": OP11_SQL, "op12_source_audit": OP12_SQL, "op13_chat_format": OP13_SQL}
