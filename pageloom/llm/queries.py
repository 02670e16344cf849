"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pageloom.llm import bpe, chat, decontaminate, fim, langid, line_dedup, near_dedup, personal, secrets, telephony, token_counts, vector_codes, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_telephony": telephony.op3_telephony,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_personal": personal.op5_personal,
    "op6_bpe": bpe.op6_bpe,
    "op7_secrets": secrets.op7_secrets,
    "op8_langid": langid.op8_langid,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_warc": warc.op10_warc,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
SQL = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_near_dedup": near_dedup.SQL,
    "op9_token_counts": token_counts.SQL,
    "op10_warc": warc.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_chat_formatting": chat.SQL,
    "op13_fill_in_middle": fim.SQL,
}
