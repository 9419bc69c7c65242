"""Queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op8_reply_trees
from .language import op7_language_id
from .lexical import ORACLE as LEXICAL
from .lexical import op13_lexical_search
from .media import op10_gif_media
from .mixing import op1_cube_mix
from .near_dup import op9_circulant_minhash
from .neighbours import op4_cross_polytope_ann
from .packing import op5_mixture_packing
from .repeats import op11_radix_repeats
from .secrets import op6_secret_randomness
from .spelling import op12_spelling_variants
from .token_store import op2_rans_tokens
from .toxicity import op3_toxicity_knn

QUERIES = {
    "op1_cube_mix": op1_cube_mix,
    "op2_rans_tokens": op2_rans_tokens,
    "op3_toxicity_knn": op3_toxicity_knn,
    "op4_cross_polytope_ann": op4_cross_polytope_ann,
    "op5_mixture_packing": op5_mixture_packing,
    "op6_secret_randomness": op6_secret_randomness,
    "op7_language_id": op7_language_id,
    "op8_reply_trees": op8_reply_trees,
    "op9_circulant_minhash": op9_circulant_minhash,
    "op10_gif_media": op10_gif_media,
    "op11_radix_repeats": op11_radix_repeats,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES: dict[str, str] = {"op13_lexical_search": LEXICAL}
