"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tilequarry.llm.audit import OP13_SQL, op13_filter_audit
from tilequarry.llm.bpe import op7_byte_bpe
from tilequarry.llm.chat import OP12_SQL, op12_chat
from tilequarry.llm.embedding_dedup import OP4_SQL, op4_embedding_dedup
from tilequarry.llm.language import op10_language_id
from tilequarry.llm.line_dedup import OP3_SQL, op3_line_dedup
from tilequarry.llm.mixing import OP8_SQL, op8_mixing
from tilequarry.llm.pii import op5_pii
from tilequarry.llm.quality import op6_quality
from tilequarry.llm.runs import op11_runs
from tilequarry.llm.secrets import op1_secrets
from tilequarry.llm.simhash import op9_simhash
from tilequarry.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_toxicity": op2_toxicity,
    "op3_line_dedup": op3_line_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
    "op11_runs": op11_runs,
    "op12_chat": op12_chat,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op3_line_dedup": OP3_SQL, "op4_embedding_dedup": OP4_SQL, "op8_mixing": OP8_SQL, "op12_chat": OP12_SQL, "op13_filter_audit": OP13_SQL}
