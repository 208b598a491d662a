"""The queries of the operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from fiscolake.llm import (alignment, decontaminate, lengths, lines, maxscore, minhash, mixing, page_text, phrases, pii,
                           suffix_tree, toxicity, urls)

QUERIES = {
    "op1_length_histogram": lengths.op1_length_histogram,
    "op2_maxscore": maxscore.op2_maxscore,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_mixing": mixing.op5_mixing,
    "op6_suffix_tree": suffix_tree.op6_suffix_tree,
    "op7_page_text": page_text.op7_page_text,
    "op8_url_filter": urls.op8_url_filter,
    "op9_minhash": minhash.op9_minhash,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_alignment": alignment.op11_alignment,
    "op12_phrases": phrases.op12_phrases,
    "op13_pii": pii.op13_pii,
}

ORACLES: dict[str, str] = {
    "op2_maxscore": maxscore.OP2_SQL,
    "op10_line_dedup": lines.OP10_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
