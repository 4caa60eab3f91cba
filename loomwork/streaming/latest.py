"""A summary that follows corrected sheets: the latest row of each output counts, whenever it arrives.

State is one row for each output. A row that replaces another takes the old one's scores out of the summary again, so
that what is kept of a batch is a row per condition, and the summary is the sum of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomwork.operators.scoring import whole_number

ROW = "condition string, version long, a int, g int"
CHANGE = "source_file string, sign int, condition string, a int, g int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _order(row: tuple) -> tuple:
    """Later versions first; of one version, nulls come before values, so that ties have one answer in any order of arrival."""
    condition, version, a, g = row
    return (version, *((x is not None, x if x is not None else 0) for x in (a, g)), (condition is not None, condition or ""))


class LatestRow(StatefulProcessor):
    """Per output the row of the largest version; emits the row that goes (-1) and the one that comes (+1)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        had = self.kept.get() if self.kept.exists() else None
        best = tuple(had) if had is not None else None
        for part in rows:
            for row in part[["condition", "version", "a", "g"]].astype(object).itertuples(index=False, name=None):
                row = tuple(None if pd.isna(x) else x if k == 0 else int(x) for k, x in enumerate(row))
                if best is None or _order(row) > _order(best):
                    best = row
        if had is None or best != tuple(had):
            self.kept.update(best)
            changes = ([] if had is None else [(key[0], -1, had[0], had[2], had[3])]) + [(key[0], 1, best[0], best[2], best[3])]
            made = pd.DataFrame(changes, columns=["source_file", "sign", "condition", "a", "g"])
            yield made.astype({"a": "Int32", "g": "Int32"})

    def close(self) -> None:
        pass


def changes(sheets: DataFrame, version: str = "version") -> DataFrame:
    """What a stream of sheets (``source_file, condition, ifs_adherence_score, grounding_score`` and a version) changes.

    Rows without an output or a version can't replace one another and take no part.
    """
    sheets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = sheets.select("source_file", "condition", F.col(version).cast("long").alias("version"), *(whole_number(F.col(c)).cast("int").alias(n) for c, n in (("ifs_adherence_score", "a"), ("grounding_score", "g"))))
    rows = rows.where("source_file is not null and version is not null")
    return rows.groupBy("source_file").transformWithStateInPandas(LatestRow(), CHANGE, "Update", "None")


def totals(changed: DataFrame) -> DataFrame:
    """What changes add to each condition: outputs, those with both scores, and sums over these."""
    both = F.col("a").isNotNull() & F.col("g").isNotNull()
    add = lambda c: F.sum(F.when(both, F.col("sign") * c).otherwise(0))
    return changed.groupBy("condition").agg(F.sum("sign").alias("outputs"), add(F.lit(1)).alias("scored"), add(F.col("a")).alias("a"), add(F.col("g")).alias("g"))


def start(sheets: DataFrame, path: str, checkpoint: str, version: str = "version", available_now: bool = False) -> StreamingQuery:
    """Keep each batch's totals in ``path/batch=<number>``; a batch that is repeated replaces its own."""
    made = changes(sheets, version).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    made = made.foreachBatch(lambda batch, n: totals(batch).write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return (made.trigger(availableNow=True) if available_now else made).start()


def summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary by condition as of the last batch, with the columns of ``scoring.score_summary``."""
    all_of = spark.read.parquet(path).groupBy("condition").agg(*(F.sum(c).alias(c) for c in ("outputs", "scored", "a", "g"))).where("outputs > 0")
    mean = lambda c: F.round(F.col(c) / F.nullif(F.col("scored"), F.lit(0)), 3)
    return all_of.select("condition", F.col("outputs").alias("total_outputs"), F.col("scored").alias("scored_outputs"), mean("a").alias("mean_ifs_adherence"), mean("g").alias("mean_grounding"))
