"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from . import oracles
from .chat import op11_chat_formatting
from .decontaminate import op1_decontamination
from .embeddings import op5_embeddings
from .mixing import op7_mixing
from .paragraphs import op10_paragraphs
from .pii import op3_pii
from .quality import op8_quality
from .resample import op13_resampling
from .secrets import op4_secrets
from .simhash import op2_simhash
from .suffixes import op9_suffix_dedup
from .toxicity import op6_toxicity
from .trie import op12_prefix_trie

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_simhash, op3_pii, op4_secrets, op5_embeddings, op6_toxicity, op7_mixing, op8_quality, op9_suffix_dedup,
        op10_paragraphs, op11_chat_formatting, op12_prefix_trie, op13_resampling,
    )
}
ORACLE_SQL = {
    "op1_decontamination": oracles.DECONTAMINATION,
    "op5_embeddings": oracles.EMBEDDINGS,
    "op11_chat_formatting": oracles.CHAT,
    "op12_prefix_trie": oracles.TRIE,
    "op13_resampling": oracles.RESAMPLING,
}
