"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from tickerloom.llm import codes, graph, impact, jaccard, language, mixing, ngrams, pages, periodic, pii, substring, tree, unigram

QUERIES = {
    "op1_topk": impact.op1_topk,
    "op2_mix": mixing.op2_mix,
    "op3_pii": pii.op3_pii,
    "op4_langid": language.op4_langid,
    "op5_lm": ngrams.op5_lm,
    "op6_extract": pages.op6_extract,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_substring": substring.op8_substring,
    "op9_pieces": unigram.op9_pieces,
    "op10_ann": tree.op10_ann,
    "op11_links": graph.op11_links,
    "op12_periodic": periodic.op12_periodic,
    "op13_codes": codes.op13_codes,
}

SQL = {
    "op1_topk": impact.SQL,
    "op2_mix": mixing.SQL,
    "op11_links": graph.SQL,
    "op13_codes": codes.SQL,
}
