"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from nearfield.llm import backoff, chat, decontaminate, mixing, pipeline, quality, sharding, simhash, suffix, toxicity, urls

QUERIES = {
    "pipeline": pipeline.run,
    "op1_counterfactual": toxicity.op1_counterfactual,
    "op2_perspectives": chat.op2_perspectives,
    "op3_ring": sharding.op3_ring,
    "op4_temporal_lists": urls.op4_temporal_lists,
    "op5_index_family": suffix.op5_index_family,
    "op6_divergence": quality.op6_divergence,
    "op7_stupid_backoff": backoff.op7_stupid_backoff,
    "op8_water_fill": mixing.op8_water_fill,
    "op9_string_tiling": decontaminate.op9_string_tiling,
    "op10_bit_sliced": simhash.op10_bit_sliced,
}

SQL = {
    "op2_perspectives": chat.OP2_SQL,
    "op4_temporal_lists": urls.OP4_SQL,
    "op6_divergence": quality.OP6_SQL,
    "op7_stupid_backoff": backoff.OP7_SQL,
    "op8_water_fill": mixing.OP8_SQL,
}
