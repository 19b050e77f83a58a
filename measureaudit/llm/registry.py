"""The queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bestfit, bitpack, chat, decontam, html, infill, lexicon, pii, quality, ranked, sharding, simhash, urls

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat": chat.op2_chat,
    "op3_urls": urls.op3_urls,
    "op4_pii": pii.op4_pii,
    "op5_tokens": bitpack.op5_tokens,
    "op6_shards": sharding.op6_shards,
    "op7_html": html.op7_html,
    "op8_quality": quality.op8_quality,
    "op9_bpe": lexicon.op9_bpe,
    "op10_decontam": decontam.op10_decontam,
    "op11_infill": infill.op11_infill,
    "op12_search": ranked.op12_search,
    "op13_packing": bestfit.op13_packing,
}
ORACLES = {"op2_chat": chat.OP2_SQL, "op3_urls": urls.OP3_SQL, "op6_shards": sharding.OP6_SQL, "op8_quality": quality.OP8_SQL, "op11_infill": infill.OP11_SQL, "op12_search": ranked.OP12_SQL}
