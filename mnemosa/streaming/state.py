"""The store's sessions and counters on streams. Times must be timestamps with zone; cast TIMESTAMP_NTZ before."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosa.operators.sessions import sessionize


def with_event_time(df: DataFrame, time: str, late: str) -> DataFrame:
    """`df` with `time` as an event time that may be `late`."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def distinct_messages(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each message once, as long as its copies come within `late` of each other."""
    return with_event_time(messages, "created_at", late).dropDuplicatesWithinWatermark(["uuid"])


def session_stream(touches: DataFrame, user: str, time: str, timeout_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """user, started_at, expires_at, n_touches of sessions, each once it is over (append mode).

    The window's gap is a microsecond short of the timeout, as a touch at the very end
    begins a new session.
    """
    gap = f"{timeout_minutes * 60_000_000 - 1} microseconds"
    timed = with_event_time(touches.filter(F.col(user).isNotNull()), time, late)
    out = timed.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n_touches"))
    return out.select(user, F.col("w.start").alias("started_at"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("expires_at"), "n_touches")


def session_batch(touches: DataFrame, user: str, time: str, timeout_minutes: int = 30) -> DataFrame:
    """What session_stream gives once all sessions are over."""
    return sessionize(touches, user, time, timeout_minutes).select(user, "started_at", "expires_at", "n_touches")


REINFORCED = "uuid string, reinforced_count int, significance int, reinforced_at timestamp, expires_at timestamp"


def reinforcement_step(promotion: int, ttl_days: int):
    """What reinforcement_stream does with the new mentions of one fact."""

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        count, significance, last, ends = state.get if state.exists else (None, 0, 0, None)
        for pdf in batches:
            for at, sig, stored, weight in sorted(zip(pdf["at"], pdf["significance"], pdf["stored_count"], pdf["stored_significance"]), key=lambda x: x[0]):
                if count is None:
                    count, significance = int(stored), int(weight)
                count += 1
                up = count >= promotion and significance < 10
                when = int(at.value // 1000)
                if up:
                    significance, ends = 10, None
                elif when >= last:
                    ends = None if sig >= 10 else when + (30 if sig >= 5 else 7) * 86_400_000_000
                last = max(last, when)
        state.update((count, significance, last, ends))
        state.setTimeoutDuration(ttl_days * 86_400_000)
        stamp = lambda us: None if us is None else pd.Timestamp(us, unit="us")
        yield pd.DataFrame({"uuid": [key[0]], "reinforced_count": [count], "significance": [significance], "reinforced_at": [stamp(last)], "expires_at": [stamp(ends)]})

    return step


def reinforcement_stream(mentions: DataFrame, promotion: int = 5, ttl_days: int = 365) -> DataFrame:
    """Running state of facts under mentions: one row per fact and batch (update mode).

    mentions: uuid, at, significance (of the mention), and what the store holds of the fact:
    stored_count and stored_significance, which the count goes on from. A fact is promoted by
    the mention that brings its count to `promotion`; one that is lasting already gets the
    expiry of its last mention, as in the store. Times never go back, whatever comes late.
    State is one small row per fact and goes when the fact wasn't mentioned for `ttl_days`.
    """
    step = reinforcement_step(promotion, ttl_days)
    return mentions.groupBy("uuid").applyInPandasWithState(step, REINFORCED, "count int, significance int, last long, ends long", "update", "ProcessingTimeTimeout")


def ingest_stream(extracted: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `apply` on each batch of extracted facts, once per batch id; the sink must skip ids it has seen."""
    return extracted.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
