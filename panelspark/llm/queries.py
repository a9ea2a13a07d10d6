"""The queries of this subpackage, for the registry at the repository top."""

from __future__ import annotations

import importlib

MODULES = ("html_extract", "language", "urlfilter", "jaccard", "sharding", "fingerprint", "quality", "ctw", "packing", "decontaminate")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
