"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import attention, impact, lattice, line_dedup, materialise, minhash, mixing, packing, quality_rules, ranked, runs, toxicity, url_filter

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_training_order": materialise.op6_training_order,
    "op7_attention": attention.op7_attention,
    "op8_mix": mixing.op8_mix,
    "op9_minhash": minhash.op9_minhash,
    "op10_lattice": lattice.op10_lattice,
    "op11_top_k": impact.op11_top_k,
    "op12_ranked": ranked.op12_ranked,
    "op13_runs": runs.op13_runs,
}
ORACLES = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op8_mix": mixing.ORACLE,
    "op9_minhash": minhash.ORACLE,
    "op10_lattice": lattice.ORACLE,
    "op11_top_k": impact.ORACLE,
    "op12_ranked": ranked.ORACLE,
}
