"""Streaming operators over events; extras beyond batch parity, and the keyed budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The events table of a folder as a stream, its times in the session's zone, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their values for each type and window; events later than ``late`` are dropped."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions, ended by a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def budgets(calls: DataFrame, allowed: int = 6) -> DataFrame:
    """Which calls (provider, at: long milliseconds, kind, wait_ms) a ledger admits.

    State for each provider: calls made, and until when it is blocked. A call is
    refused while blocked or when the budget is spent; a block or a demand to log
    in ends a provider's calls, a rate limit holds them for a while.
    """

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used, until = state.get if state.exists else (0, -1)
        for rows in batches:
            out = []
            for r in rows.sort_values("at").itertuples():
                fine = used < allowed and (until < 0 or (until > 0 and r.at >= until))
                out.append(fine)
                if fine:
                    used, until = used + 1, -1
                    if r.kind in ("blocked", "authRequired"):
                        until = 0  # for good
                    elif r.kind == "rateLimited":
                        until = int(r.at + (r.wait_ms or 5000))
            yield rows.sort_values("at").assign(admitted=out)[["provider", "at", "kind", "admitted"]]
        state.update((used, until))

    return calls.groupBy("provider").applyInPandasWithState(
        admit, "provider string, at long, kind string, admitted boolean", "used long, until long", "append", "NoTimeout"
    )


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no earlier run has done."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def run_to_end(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Everything that a stream gives for the data there is now, as a table in memory; for tests and small streams."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
