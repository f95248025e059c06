"""The queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from .html_text import op9_html_extraction
from .language import op10_language_id
from .mixing import op4_mixing
from .near_dedup import op1_minhash_near_dedup
from .near_vectors import OP6_SQL, op6_embedding_near_dedup
from .piece_bpe import op7_sentencepiece
from .secrets import op2_secret_scan
from .sharding import op3_sharding
from .token_files import op8_token_files
from .topk import OP5_SQL, op5_top_products

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_top_products": op5_top_products,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_files": op8_token_files,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
}

ORACLES = {"op5_top_products": OP5_SQL, "op6_embedding_near_dedup": OP6_SQL}
