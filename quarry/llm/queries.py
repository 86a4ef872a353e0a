"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from quarry.llm import chat, dedup, html, langid, media, mixing, packing, pii, rans, topk

QUERIES = {
    "op10_exact_topk": topk.op10_topk,
    "op6_media": media.op6_media,
    "op7_rans": rans.op7_rans,
    "op9_min_bin_slack": packing.op9_packing,
    "op3_langid": langid.op3_langid,
    "op4_mixing": mixing.op4_mixing,
    "op8_chat": chat.op8_chat,
    "op5_jaccard_join": dedup.op5_jaccard_join,
    "op2_pii": pii.op2_pii,
    "op1_html": html.op1_html,
}
ORACLES = {
    "op10_exact_topk": topk.OP10_SQL,
}
