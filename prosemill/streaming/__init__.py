"""Rules over streams of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prosemill.plans.lint import chosen, lint
from prosemill.plans.profile import Profile

#: Rules whose windows or joins span rows of a document; they need whole micro-batches.
BATCHED = {"CORE.HEADING_SKIP", "CORE.SINGLE_ITEM_LIST", "CORE.TERM_CONSISTENCY", "CORE.TERM_UNKNOWN", "CORE.UNEXPANDED_ABBREV", "CORE.DENSE_PARAGRAPH", "CORE.CORPUS_NOVELTY"}


def stateless(docs: DataFrame, profile: Profile, only: list[str] | None = None) -> DataFrame:
    """Findings of a stream of documents by the rules that look at one row at a time, as a stream."""
    ids = [i for i in (only or chosen(profile)) if i not in BATCHED]
    return lint(docs, profile, only=ids, keep=False)


def lint_stream(docs: DataFrame, profile: Profile, path: str, checkpoint: str, only: list[str] | None = None) -> StreamingQuery:
    """Writes the findings of all rules on a stream of whole documents as Parquet, a folder for each micro-batch, which a batch
    that runs again replaces."""

    def write(batch: DataFrame, number: int) -> None:
        lint(batch, profile, only=only, keep=False).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
