"""The registered queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .ann import op10_rp_forest
from .curriculum import OP7_SQL, op7_curriculum_mix
from .decontaminate import OP9_SQL, op9_decontaminate
from .jaccard import OP2_SQL, op2_ngram_jaccard
from .lexical import OP12_SQL, op12_inverted_treaps
from .lines import OP1_SQL, op1_line_dedup
from .packing import op13_histogram_packing
from .pii import op6_context_pii
from .secrets import op3_secret_scan
from .sharding import op4_label_propagation_shards
from .tokens import op5_binary_records
from .toxicity import op8_toxicity
from .whitening import op11_chan_whitening

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_jaccard, op3_secret_scan, op4_label_propagation_shards, op5_binary_records, op6_context_pii, op7_curriculum_mix, op8_toxicity, op9_decontaminate, op10_rp_forest, op11_chan_whitening, op12_inverted_treaps, op13_histogram_packing)}
SQL = {"op1_line_dedup": OP1_SQL, "op2_ngram_jaccard": OP2_SQL, "op7_curriculum_mix": OP7_SQL, "op9_decontaminate": OP9_SQL, "op12_inverted_treaps": OP12_SQL}
