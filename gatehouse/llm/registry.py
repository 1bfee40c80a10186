"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from gatehouse.llm.chat_format import OP2_SQL, op2_chat_format
from gatehouse.llm.fingerprints import op7_fingerprints
from gatehouse.llm.importance import op13_importance
from gatehouse.llm.line_dedup import op4_line_dedup
from gatehouse.llm.mixing import op10_mixing
from gatehouse.llm.nearest import op9_nearest
from gatehouse.llm.ngram_join import op1_ngram_join
from gatehouse.llm.sentencepiece_codec import op5_sentencepiece
from gatehouse.llm.token_counts import op6_token_counts
from gatehouse.llm.token_files import op8_token_files
from gatehouse.llm.toxicity import op3_toxicity
from gatehouse.llm.url_filters import op11_url_filters
from gatehouse.llm.whitening import op12_whitening

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_chat_format": op2_chat_format,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_token_counts": op6_token_counts,
    "op7_fingerprints": op7_fingerprints,
    "op8_token_files": op8_token_files,
    "op9_nearest": op9_nearest,
    "op10_mixing": op10_mixing,
    "op11_url_filters": op11_url_filters,
    "op12_whitening": op12_whitening,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {"op2_chat_format": OP2_SQL}
