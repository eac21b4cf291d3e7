"""The queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from millrace.llm import byte_cnn, containment, fingerprint_index, mixing, order_minhash, pii, quality, radix_suffix, suffix_tree, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_quality_ledger": quality.op2_quality_ledger,
    "op3_surrogates": pii.op3_surrogates,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_order_minhash": order_minhash.op5_order_minhash,
    "op6_fingerprint_index": fingerprint_index.op6_fingerprint_index,
    "op7_containment": containment.op7_containment,
    "op8_suffix_tree": suffix_tree.op8_suffix_tree,
    "op9_radix_suffix": radix_suffix.op9_radix_suffix,
    "op10_language_id": byte_cnn.op10_language_id,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op2_quality_ledger": quality.OP2_SQL,
    "op7_containment": containment.OP7_SQL,
}
