"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from kotonoha.llm import bm25_search, licenses
from kotonoha.llm.bm25_search import op7_bm25_search
from kotonoha.llm.byte_bpe import op5_byte_bpe
from kotonoha.llm.context_mix import op2_context_mix
from kotonoha.llm.conversations import op13_conversations
from kotonoha.llm.decontaminate import op6_decontaminate
from kotonoha.llm.language_id import op1_language_id
from kotonoha.llm.licenses import op3_licenses
from kotonoha.llm.line_dedup import op4_line_dedup
from kotonoha.llm.quality import op11_quality
from kotonoha.llm.secrets import op8_secrets
from kotonoha.llm.simhash import op10_simhash
from kotonoha.llm.spelling import op12_spelling
from kotonoha.llm.toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (op1_language_id, op2_context_mix, op3_licenses, op4_line_dedup, op5_byte_bpe, op6_decontaminate, op7_bm25_search, op8_secrets, op9_toxicity, op10_simhash, op11_quality, op12_spelling, op13_conversations)}
ORACLE_SQL: dict[str, str] = {"op3_licenses": licenses.ORACLE, "op7_bm25_search": bm25_search.ORACLE}
