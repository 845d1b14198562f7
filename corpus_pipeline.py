"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns the documents it keeps (the last one the encoded documents).  ``run``
writes every stage's result as Parquet in the shared checkpoint folder and
reads it back as the next stage's input."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from healthwatch.llm import exact_dedup, mixing, near_dup, quality, spm  # noqa: E402
from healthwatch.llm.common import read, write_table  # noqa: E402

STAGES = [
    ("quality_rules", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dup.stage),
    ("mixing", mixing.stage),
    ("sentencepiece", spm.stage),
]

#: The stages draw at random (mixing) and search by signatures, which SQL
#: cannot express; tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply all stages to ``documents``; the encoded documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
