"""The modules of this subpackage that register queries: each has QUERIES, and ORACLES with the SQL of those that SQL can express."""

MODULES = ["bpe", "quality", "toxicity", "licenses", "html_text", "urls", "simhash", "decontaminate", "substrings", "neighbours", "codes", "language", "middle"]
