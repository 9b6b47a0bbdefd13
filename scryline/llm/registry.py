"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from scryline.llm import align, cluster, decontaminate, language, lines, lm, minhash, packing, quality, secrets, sharding, simhash, urls

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_minhash": minhash.op4_minhash,
    "op5_url_filter": urls.op5_url_filter,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_language": language.op7_language,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_lm_scoring": lm.op10_lm_scoring,
    "op11_clustering": cluster.op11_clustering,
    "op12_secrets": secrets.op12_secrets,
    "op13_alignment": align.op13_alignment,
}

SQL = {"op5_url_filter": urls.OP5_SQL, "op9_line_dedup": lines.OP9_SQL, "op11_clustering": cluster.OP11_SQL}
