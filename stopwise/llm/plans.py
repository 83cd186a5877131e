"""Registry of this subpackage: name -> query, name -> SQL."""

from stopwise.llm.decontaminate import op4_decontaminate
from stopwise.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from stopwise.llm.html_text import op3_html_text
from stopwise.llm.language_model import op12_lm_scoring
from stopwise.llm.mixing import OP8_SQL, op8_mixing
from stopwise.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from stopwise.llm.sharding import op1_sharding
from stopwise.llm.simhash import op2_simhash
from stopwise.llm.suffix_dedup import op9_suffix_dedup
from stopwise.llm.token_files import op6_token_files
from stopwise.llm.toxicity import op10_toxicity
from stopwise.llm.url_filter import OP5_SQL, op5_url_filter
from stopwise.llm.whitening import op13_whitening

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_html_text": op3_html_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_url_filter": op5_url_filter,
    "op6_token_files": op6_token_files,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op5_url_filter": OP5_SQL, "op7_exact_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op11_prefix_trie": OP11_SQL}
