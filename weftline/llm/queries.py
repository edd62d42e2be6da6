"""The subpackage's entries for ``queries()`` and ``oracle_sql()``."""

from .collocations import OP13_SQL, op13_phrase_collocations
from .decontamination import op7_decontamination
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .licenses import op8_license_scan
from .lm_scoring import op2_lm_scoring
from .mixing import op3_mixing
from .near_dup import OP10_SQL, op10_ngram_jaccard
from .nearest import op12_nearest_neighbours
from .sharding import op1_sharding
from .substring_dedup import OP5_SQL, op5_substring_dedup
from .token_counts import op9_token_counts
from .toxicity import op6_toxicity
from .vector_codes import OP11_SQL, op11_vector_compression

QUERIES = {f.__name__: f for f in (op1_sharding, op2_lm_scoring, op3_mixing, op4_exact_dedup, op5_substring_dedup, op6_toxicity, op7_decontamination, op8_license_scan, op9_token_counts, op10_ngram_jaccard, op11_vector_compression, op12_nearest_neighbours, op13_phrase_collocations)}
#: The others keep hashes, models or a vocabulary that SQL has no form for; tests compare those with brute force.
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op10_ngram_jaccard": OP10_SQL, "op11_vector_compression": OP11_SQL, "op13_phrase_collocations": OP13_SQL}
