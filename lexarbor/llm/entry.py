"""The queries of this package and their SQL."""

from __future__ import annotations

from . import ann_graph, byte_bpe, chat_format, html_extract, language_id, license_scan, line_dedup, mixing, ngram_join, quality_rules

QUERIES = {f.__name__: f for f in (mixing.op1_mix, language_id.op2_language_id, html_extract.op3_html, byte_bpe.op4_byte_bpe, quality_rules.op5_quality, ann_graph.op6_ann, ngram_join.op7_ngram_join, license_scan.op8_license_scan, line_dedup.op9_line_dedup, chat_format.op10_chat_format)}
SQL = {"op1_mix": mixing.OP1_SQL, "op8_license_scan": license_scan.OP8_SQL, "op9_line_dedup": line_dedup.OP9_SQL, "op10_chat_format": chat_format.OP10_SQL}
