"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from harvestry.llm import fingerprint, hpylm, language_id, mixing, packing, simhash, substring_dedup, url_filter, vantage, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_nearest": vantage.op2_nearest,
    "op3_warc": warc.op3_warc,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_fingerprints": fingerprint.op5_fingerprints,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_packing": packing.op8_packing,
    "op9_hpylm": hpylm.op9_hpylm,
    "op10_language_id": language_id.op10_language_id,
}

SQL = {
    "op1_substring_dedup": substring_dedup.OP1_SQL,
    "op2_nearest": vantage.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
}
