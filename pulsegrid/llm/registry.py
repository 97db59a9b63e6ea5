"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import conversations, decontaminate, fingerprint, language, lattice, minhash, mixing, pieces, pii, quality, token_files, toxicity, url_filter

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_pii": pii.op2_pii,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_tokens": token_files.op4_tokens,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_language": language.op8_language,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_minhash": minhash.op10_minhash,
    "op11_conversations": conversations.op11_conversations,
    "op12_lattice": lattice.op12_lattice,
    "op13_pieces": pieces.op13_pieces,
}
ORACLE_SQL = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op12_lattice": lattice.OP12_SQL,
}
