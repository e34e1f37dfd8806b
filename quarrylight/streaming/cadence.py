"""Commit cadence over a stream, an extension of the batch operators: windows with a watermark, and pauses by author."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cadence(commits: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, author, commits) of streamed commits (ts timestamp, author): one row per window and author once the watermark has passed it."""
    counted = commits.withWatermark("ts", late).groupBy(F.window("ts", window), "author").agg(F.count("*").alias("commits"))
    return counted.select(F.col("window.start").alias("start"), "author", "commits")


def longest_pauses(commits: DataFrame) -> DataFrame:
    """(author, last_ts, longest): each author's longest pause in seconds so far, emitted when it changes; the state is two numbers an author."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, longest = state.get if state.exists else (None, 0)
        before = longest
        for t in sorted(t for pdf in batches for t in pdf["seconds"]):
            longest = max(longest, t - last) if last is not None else longest
            last = t if last is None else max(last, t)
        state.update((int(last), int(longest)))
        if longest != before:
            yield pd.DataFrame({"author": [key[0]], "last_ts": [int(last)], "longest": [int(longest)]})

    rows = commits.select("author", F.unix_timestamp("ts").alias("seconds"))
    return rows.groupBy("author").applyInPandasWithState(update, "author bigint, last_ts bigint, longest bigint", "last bigint, longest bigint", "update", "NoTimeout")
