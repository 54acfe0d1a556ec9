"""The corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

from lectern.llm import bpe, brown, chat, decontaminate, importance, langid, neardup, order_minhash, packing, quality, reputation, structure, toxicity

QUERIES = {
    "op2_packing": packing.query,
    "op8_order_minhash": order_minhash.query,
    "op6_brown": brown.query,
    "op1_quality": quality.query,
    "op5_toxicity": toxicity.query,
    "op3_chat": chat.query,
    "op10_reputation": reputation.query,
    "op4_decontaminate": decontaminate.query,
    "op7_bpe": bpe.query,
    "op9_minhash": neardup.query,
    "op11_langid": langid.query,
    "op12_importance": importance.query,
    "op13_structure": structure.query,
}
ORACLES: dict[str, str] = {
    "op3_chat": chat.ORACLE,
    "op10_reputation": reputation.ORACLE,
    "op4_decontaminate": decontaminate.ORACLE,
    "op9_minhash": neardup.ORACLE,
    "op12_importance": importance.ORACLE,
    "op13_structure": structure.ORACLE,
}
