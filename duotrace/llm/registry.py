"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .conversations import op12
from .decontamination import op7
from .licenses import op13
from .lines import op3
from .media import op8
from .neardup import op2
from .oracles import DECONTAMINATION, SEARCH, SUBSTRINGS, TRIE, WARC
from .packing import op5
from .ranked import op11
from .sharding import op6
from .substrings import op9
from .suffix_tree import op10
from .toxicity import op4
from .warc import op1

QUERIES = {"op1_arc_to_warc": op1, "op2_hyperminhash": op2, "op3_fuzzy_lines": op3, "op4_counterfactual_toxicity": op4, "op5_mixture_packing": op5, "op6_minimax_shards": op6, "op7_winnowing": op7, "op8_chunk_store": op8, "op9_block_anchors": op9, "op10_suffix_tree": op10, "op11_seeded_search": op11, "op12_leaf_peeling": op12, "op13_signature_rules": op13}

ORACLES = {"op1_arc_to_warc": WARC, "op7_winnowing": DECONTAMINATION, "op9_block_anchors": SUBSTRINGS, "op11_seeded_search": SEARCH, "op12_leaf_peeling": TRIE}
