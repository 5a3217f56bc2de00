"""A corpus pipeline of five operators: what each stage keeps is written as Parquet and is the next one's input."""

from __future__ import annotations

from wflog.llm.common import materialize
from wflog.llm.decontaminate import decontaminate_stage
from wflog.llm.line_dedup import line_dedup_stage
from wflog.llm.mixing import mix_stage
from wflog.llm.quality_rules import quality_stage
from wflog.llm.simhash import simhash_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
]

#: Edit distance joins, fingerprints and components have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
