"""Politeness as a stateful stream: waits, stalls, merged samples and rate limits of each host, in the order of events.

Events of a host may come in any order within the watermark's delay. They are kept in the host's state until the watermark
has passed them and then folded in the order of time, so results don't depend on how events are dealt to batches, and a
stream that is stopped goes on from its checkpoint. The state of a host is the events of one delay, at most SAMPLES samples
and a few numbers; hosts are spread over tasks by Spark, and none is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webframe.operators.stats import SAMPLES, SampleFold

#: what becomes of each event: sample_* are null unless it ends a sample
OUT = "host string, t long, failed boolean, wait double, sample_seconds double, sample_bytes long, stalled boolean, speed double, sleep double"
#: events that came together are one row, as each row of a state is converted by itself
_EVENTS = "t array<long>, n array<long>, failed array<boolean>"
_STATE = "begin long, held long, stalled boolean, errors int, seconds array<double>, sizes array<long>"


@dataclass(frozen=True)
class Rules:
    """``wait``: seconds between requests; each error in a row adds one, up to ``waitretry`` more; ``limit``: bytes a second (0:
    none); ``hook``: seconds from seconds, for a wait_time of one's own."""

    wait: float = 0.0
    waitretry: float = 10.0
    limit: float = 0.0
    least: float = 0.15
    stall: float = 5.0
    hook: Callable[[float], float] | None = None


class HostFold:
    """One host's events in the order of time."""

    def __init__(self, rules: Rules):
        self.rules, self.samples = rules, SampleFold(rules.least, rules.stall)
        self.errors, self.seconds, self.sizes = 0, [], []

    def load(self, begin, held, stalled, errors, seconds, sizes) -> None:
        self.samples.begin, self.samples.held, self.samples.stalled = None if begin is None else int(begin), int(held), bool(stalled)
        self.errors, self.seconds, self.sizes = int(errors), [float(x) for x in seconds], [int(x) for x in sizes]

    def saved(self) -> tuple:
        return (self.samples.begin, self.samples.held, self.samples.stalled, self.errors, self.seconds, self.sizes)

    def event(self, t: int, n: int, failed: bool) -> tuple:
        """The columns of OUT behind host: a success ends the back-off, and only a sample moves speed and sleep."""
        r = self.rules
        self.errors = self.errors + 1 if failed else 0
        wait = min(r.wait + self.errors, r.wait + r.waitretry)
        made = self.samples.feed(t, n)
        if made:
            self.seconds, self.sizes = [*self.seconds, made[0]][-SAMPLES:], [*self.sizes, made[1]][-SAMPLES:]
        time, size = sum(self.seconds), sum(self.sizes)
        speed = size / time if time > 0 else 0.0
        rest = size / r.limit - time if r.limit else 0.0
        sleep = rest if rest >= 0.001 else 0.0
        return (t, failed, r.hook(wait) if r.hook else wait, made[0] if made else None, made[1] if made else None, self.samples.stalled, speed, sleep)


def _due(t: int) -> int:
    """The millisecond at which all events of microsecond ``t`` are passed."""
    return t // 1000 + 1


class Politeness(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _EVENTS)
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Keeps the events and sets one timer, for the first of them: each call of the handle is a message to the JVM."""
        first = None
        for batch in rows:
            if len(batch):
                self.pending.appendValue(tuple(batch[c].tolist() for c in ("t", "n", "failed")))
                least = int(batch["t"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(_due(first))
        yield from ()  # an empty frame for each host would cost more than its events

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All events that the watermark has passed, and a timer for the first of the rest; what another timer finds then is
        nothing, or the rest."""
        passed_by = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = sorted((int(t), int(n), bool(f)) for events in self.pending.get() for t, n, f in zip(*events, strict=True))
        passed = [e for e in held if _due(e[0]) <= passed_by]
        if passed:
            fold = HostFold(self.rules)
            if self.state.exists():
                fold.load(*self.state.get())
            out = [(key[0], *fold.event(*e)) for e in passed]
            self.state.update(fold.saved())
            rest = held[len(passed) :]
            self.pending.clear()
            if rest:
                self.pending.put([tuple(map(list, zip(*rest, strict=True)))])
                self.handle.registerTimer(_due(rest[0][0]))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def polite(events: DataFrame, rules: Rules | None = None, late: str = "10 seconds", host_col: str = "host", time_col: str = "ts", bytes_col: str = "size", failed_col: str = "failed") -> DataFrame:
    """OUT for each event of a stream (host, time, bytes, failed) once the watermark has passed it. The session's state store
    must be one that keeps several states, as RocksDB's is."""
    rows = events.select(F.col(host_col).cast("string").alias("host"), F.col(time_col).cast("timestamp").alias("ts"), F.coalesce(F.col(bytes_col).cast("long"), F.lit(0)).alias("n"), F.coalesce(F.col(failed_col), F.lit(False)).alias("failed"))
    rows = rows.filter(F.col("host").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("host").transformWithStateInPandas(Politeness(rules or Rules()), OUT, "append", "eventTime")
