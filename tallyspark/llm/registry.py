"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyspark.llm import bpe, decontaminate, html_text, jaccard, language_model, lines, media, quality, ranking, substrings, toxicity, tries, warc

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_warc": warc.query,
    "op3_media": media.query,
    "op4_quality": quality.query,
    "op5_language_model": language_model.query,
    "op6_toxicity": toxicity.query,
    "op7_html_text": html_text.query,
    "op8_jaccard": jaccard.query,
    "op9_substrings": substrings.query,
    "op10_decontaminate": decontaminate.query,
    "op11_prefix_trie": tries.query,
    "op12_search": ranking.query,
    "op13_line_dedup": lines.query,
}
SQL = {
    "op2_warc": warc.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_prefix_trie": tries.SQL,
    "op12_search": ranking.SQL,
    "op13_line_dedup": lines.SQL,
}
