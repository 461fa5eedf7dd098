"""Analysis of changed files as they arrive, with Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.extract import facts as extract_facts
from plumbline.operators import code
from plumbline.operators.base import SMELL_COLUMNS
from plumbline.plans.config import load


def code_smells(changes: DataFrame, output: str, checkpoint: str, config: str | dict | None = None, strict: bool = True) -> StreamingQuery:
    """changes: a stream of (path, root, content). Each batch's files are analyzed by the code family, whose rules need one file only, and written to
    output/batch=N as Parquet; a batch that is run again overwrites its own folder. strict as in the batch engine: the same files have the same
    smells."""
    thresholds = load(config)["code_smells"]

    def one(batch: DataFrame, number: int) -> None:
        facts = extract_facts(batch).persist()
        smells = reduce(DataFrame.unionByName, [d(facts, thresholds) for d in code.DETECTORS.values()])
        smells = code.strict(smells, facts, thresholds) if strict else smells
        smells.select(*SMELL_COLUMNS).write.mode("overwrite").parquet(f"{output}/batch={number}")
        facts.unpersist()

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
