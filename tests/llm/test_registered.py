"""The operators that must be registered, by name."""

import __spark_entry__ as entry

NAMES = {
    "op1_byte_bpe",
    "op2_quality_classifier",
    "op3_url_filter",
    "op4_decontamination",
    "op5_token_counts",
    "op6_toxicity",
    "op7_html_text",
    "op8_simhash",
    "op9_quality_rules",
    "op10_lm_scores",
    "op11_whitening",
    "op12_collocations",
    "op13_warc",
    "pipeline",
}


def test_all_operators_are_registered():
    assert NAMES <= set(entry.queries())
    assert {"op3_url_filter", "op4_decontamination", "op9_quality_rules", "op12_collocations", "op13_warc"} <= set(entry.oracle_sql())
