"""The queries of this subpackage, by the names that ``__spark_entry__`` publishes."""

from __future__ import annotations

from .embeddings import op1_embedding_dedup
from .jaccard import op6_ngram_jaccard
from .licences import op4_license_scan
from .lines import op3_line_dedup
from .mixing import op2_mixing
from .oracles import ORACLES
from .packing import op10_best_fit_packing
from .quality import op5_quality
from .simhash import op8_simhash
from .store import op9_token_store
from .toxicity import op7_toxicity

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (op1_embedding_dedup, op2_mixing, op3_line_dedup, op4_license_scan, op5_quality, op6_ngram_jaccard, op7_toxicity, op8_simhash, op9_token_store, op10_best_fit_packing)
}
