"""The queries of this subpackage and their SQL twins."""

import importlib

_MODULES = ["fingerprints", "mixing", "chat_format", "ngram_join", "quality_rules", "toxicity", "piece_tokenizer",
            "html_extraction", "line_dedup", "warc", "merkle", "divergence", "lm_scoring"]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in _MODULES:
    _module = importlib.import_module(f"tableloom.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE.update(getattr(_module, "ORACLE", {}))
