"""Arrivals of compounds: the first of each structure is kept, and told whether it lies in the domain.

State holds one small row a structure, whatever the number of its copies, and
lives in the stream's checkpoint, so a restarted stream knows what it has seen.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.domain import leverage


def first_arrivals(arrivals: DataFrame, key: str, order: str, ts: str | None = None, late: str = "10 minutes", forget: str | None = None) -> DataFrame:
    """Of each key the row that comes first: in the earliest batch, the least by ``order``.

    Adds ``copies``, the rows of the key in that batch.  Later rows of a known
    key give nothing.  With ``ts`` and ``forget`` a key is forgotten when the
    watermark of ``ts`` passes its last row by that much, and may come again.
    Rows with a null key or order are left out.  Rows that tie in ``order``
    are told apart by all their values, as texts.
    """
    schema = arrivals.select("*", F.lit(0).cast("long").alias("copies")).schema
    columns = arrivals.columns
    rows = arrivals.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    timed = ts is not None and forget is not None
    if timed:
        rows = rows.withWatermark(ts, late)
        span = int(pd.Timedelta(forget).total_seconds() * 1000)

    def seen(known: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, n, latest = None, 0, 0
        for pdf in batches:
            n += len(pdf)
            least = pdf[pdf[order] == pdf[order].min()]
            for row in least.itertuples(index=False):
                rank = (row[columns.index(order)], tuple(map(str, row)))
                first = (rank, row) if first is None or rank < first[0] else first
            if timed:
                latest = max(latest, int(pdf[ts].max().timestamp() * 1000))
        fresh = not state.exists
        state.update((n + (0 if fresh else state.get[0]),))
        if timed:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + span)
        if fresh:
            yield pd.DataFrame([(*first[1], n)], columns=[*columns, "copies"])

    wait = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(seen, schema, "n long", "append", wait)


def with_domain(arrivals: DataFrame, features: str, inverse: np.ndarray, n_train: int) -> DataFrame:
    """Add ``leverage`` and ``in_domain`` by a training set's inverse and number of rows; a response is not needed."""
    limit = 3 * len(inverse) / n_train
    return arrivals.withColumn("leverage", leverage(features, inverse)).withColumn("in_domain", F.col("leverage") <= limit)
