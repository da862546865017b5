"""Operators for preparing training text: fingerprints, mixing, chat formatting, near-duplicate joins,
quality rules, toxicity, tokenisation, HTML extraction, line deduplication and WARC derivatives.

Nothing else in the library imports this subpackage."""
