"""The loudest pair of each family over an unbounded stream, with a keyed state of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotrace.config import SearchConfig

OUT = "fold int, bi long, l1bin long, net double, ai long, ih long, il long, n long"
STATE = "net double, ai long, ih long, il long, n long"


def family_maxima(pairs: DataFrame, config: SearchConfig = SearchConfig(), delay: str = "30 seconds") -> DataFrame:
    """A row for each family (fold, bi, l1bin) of the stream of pairs (fold, ai, ih, bi, il, ts, net) with net at the floor or above: its loudest
    pair, the first of equals by (ai, ih, il), and how many pairs it had.

    ts is the second stream's time. A family's state is one row: the best so far and a count, however many pairs come. A
    timer on event time ends it: once the watermark has passed its last second its row is sent and its state dropped.
    State and timers lie in the checkpoint, so a query that is stopped and started again goes on from there.
    """
    width_ms = round(config.family_s * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            net, ai, ih, il, n = state.get
            state.remove()
            yield pd.DataFrame([(*key, net, ai, ih, il, n)], columns=[c.split()[0] for c in OUT.split(", ")])
            return
        best = state.get if state.exists else None
        for f in frames:
            top = f.sort_values(["net", "ai", "ih", "il"], ascending=[False, True, True, True]).iloc[0]
            new = (float(top["net"]), int(top["ai"]), int(top["ih"]), int(top["il"]))
            held = best[4] if best else 0
            if best is None or (-new[0], *new[1:]) < (-best[0], *best[1:4]):
                best = (*new, held)
            best = (*best[:4], held + len(f))
        state.update(best)
        state.setTimeoutTimestamp(max((int(key[2]) + 1) * width_ms, state.getCurrentWatermarkMs() + 1))

    rows = pairs.filter(F.col("net") >= config.net_floor).withWatermark("ts", delay)
    binned = rows.withColumn("l1bin", F.floor(F.unix_millis("ts") / width_ms))
    return binned.groupBy("fold", "bi", "l1bin").applyInPandasWithState(step, OUT, STATE, "append", "EventTimeTimeout")
