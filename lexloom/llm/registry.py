"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexloom.llm import exact_dedup, html_extract, mixing, packing, quality, secrets, sharding, simhash, substring_dedup, token_output

QUERIES = {
    "op1_shard": sharding.op1_shard,
    "op2_quality": quality.op2_quality,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_simhash": simhash.op4_simhash,
    "op5_token_output": token_output.op5_token_output,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_pack": packing.op7_pack,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_mix": mixing.op9_mix,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLE = {"op6_exact_dedup": exact_dedup.SQL, "op8_secret_scan": secrets.SQL}
