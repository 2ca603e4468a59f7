"""The queries of this subpackage and the SQL they are held against."""

from loomgraph.llm import chat, decontaminate, neardup, packing, quality, repeats, secrets, tokencount, urls, warc

QUERIES = {
    "op1_suffix_dedup": repeats.op1_suffix_dedup,
    "op2_warc": warc.op2_warc,
    "op3_perspectives": chat.op3_perspectives,
    "op4_pack": packing.op4_pack,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_secrets": secrets.op6_secrets,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_url_filter": urls.op8_url_filter,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL = {
    "op2_warc": warc.SQL,
    "op3_perspectives": chat.SQL,
    "op8_url_filter": urls.SQL,
    "op10_decontaminate": decontaminate.SQL,
}
