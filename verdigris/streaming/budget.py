"""A hard spend cap with reservations for work in flight, as state by budget.

A request reserves the most it can cost before it goes out and settles what it did cost when it comes back. It is granted
only while spent + reserved + its own reservation stay within the cap. A reservation that isn't settled in time
expires: its amount is taken as spent, since the work may have been done, and a settlement that comes later puts the true
amount in its place. So as long as no request costs more than it reserved, a budget's spending never passes its cap,
whatever the order of settlements and wherever the query is stopped and started again.

The rows of a budget are handled in order of (ts, settlements first, request_id) within a micro-batch. A request is known from its
reservation until ``known_for`` after its deadline: until then a repeated reservation gets its first answer and a repeated
settlement changes nothing. State: one row a budget and one a known request; timers drop the latter.

Amounts are whole numbers (micro-dollars, say), so that sums are exact. Rows with a null budget, request_id, ts or amount, a negative
amount or another kind come out as ``invalid`` and change nothing. A budget is one sequence of decisions and so one task
a batch; many budgets are dealt over all.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from verdigris.session import ship_package

OUT = "budget string, request_id string, ts timestamp, verdict string, spent long, reserved long"
#: What is known of a request.
OPEN, EXPIRED, SETTLED, REFUSED = range(4)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ledger:
    """The decisions of one budget. ``known``: request_id: [reserved amount, deadline in ms, state]."""

    def __init__(self, cap: int, spent: int = 0, reserved: int = 0):
        self.cap, self.spent, self.reserved = cap, spent, reserved

    def reserve(self, entry: list[int] | None, amount: int, deadline: int) -> tuple[str, list[int]]:
        if entry is not None:
            return ("refused" if entry[2] == REFUSED else "granted"), entry
        if self.spent + self.reserved + amount > self.cap:
            return "refused", [amount, deadline, REFUSED]
        self.reserved += amount
        return "granted", [amount, deadline, OPEN]

    def settle(self, entry: list[int] | None, actual: int) -> tuple[str, list[int] | None]:
        if entry is None or entry[2] == REFUSED:
            return "unknown", entry
        if entry[2] == SETTLED:
            return "repeated", entry
        if entry[2] == OPEN:
            self.reserved -= entry[0]
            self.spent += actual
            return "settled", [entry[0], entry[1], SETTLED]
        self.spent += actual - entry[0]
        return "late", [entry[0], entry[1], SETTLED]

    def expire(self, entry: list[int]) -> list[int]:
        self.reserved -= entry[0]
        self.spent += entry[0]
        return [entry[0], entry[1], EXPIRED]


class BudgetProcessor(StatefulProcessor):
    def __init__(self, cap: int, in_time_ms: int, known_for_ms: int):
        self.cap, self.in_time, self.known_for = cap, in_time_ms, known_for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.handle = handle
        self.total = handle.getValueState("total", number("spent", "reserved"))
        self.known = handle.getMapState("known", StructType([StructField("request_id", StringType())]), number("amount", "deadline", "state"))

    def _ledger(self) -> Ledger:
        return Ledger(self.cap, *(self.total.get() if self.total.exists() else (0, 0)))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ledger, out = self._ledger(), []
        batch = pd.concat(list(rows), ignore_index=True)
        batch["later"] = batch["kind"] != "settle"
        for r in batch.sort_values(["ts", "later", "request_id"], kind="stable").itertuples():
            name = (r.request_id,)
            entry = list(self.known.getValue(name)) if self.known.containsKey(name) else None
            if r.kind == "reserve":
                verdict, now = ledger.reserve(entry, int(r.amount), int(r.ts.value // 1_000_000) + self.in_time)
                if entry is None:
                    self.handle.registerTimer(now[1])
                    self.handle.registerTimer(now[1] + self.known_for)
            else:
                verdict, now = ledger.settle(entry, int(r.amount))
            if now is not None and now != entry:
                self.known.updateValue(name, tuple(now))
            out.append((key[0], r.request_id, r.ts, verdict, ledger.spent, ledger.reserved))
        self.total.update((ledger.spent, ledger.reserved))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, ledger, out = expiredTimerInfo.getExpiryTimeInMs(), self._ledger(), []
        for name, entry in list(self.known.iterator()):
            if entry[2] == OPEN and entry[1] <= now:
                self.known.updateValue(name, tuple(ledger.expire(list(entry))))
                out.append((key[0], name[0], pd.Timestamp(entry[1], unit="ms"), "expired", ledger.spent, ledger.reserved))
            elif entry[1] + self.known_for <= now:
                self.known.removeKey(name)
        self.total.update((ledger.spent, ledger.reserved))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def with_reservations(events: DataFrame, cap: int, in_time: timedelta = timedelta(minutes=15), known_for: timedelta = timedelta(days=1), lateness: str = "10 minutes") -> DataFrame:
    """budget, request_id, ts, verdict, spent, reserved for each row of a stream (budget, request_id, ts, kind, amount), and for
    each reservation that expires; spent and reserved are the budget's after it.

    Verdicts: granted, refused (kind ``reserve``); settled, late, repeated, unknown (kind ``settle``); expired; invalid. Time is that of
    the events: a reservation expires when the watermark, ``lateness`` behind the latest event, passes its deadline; events later
    than the watermark are still decided on."""
    spark = events.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the only one that keeps several states a key
    whole = F.col("budget").isNotNull() & F.col("request_id").isNotNull() & F.col("ts").isNotNull() & (F.col("amount") >= 0) & F.col("kind").isin("reserve", "settle")
    sound = F.coalesce(whole, F.lit(False))
    rows = events.select(F.col("budget").cast("string"), F.col("request_id").cast("string"), F.col("ts").cast("timestamp"), F.col("kind").cast("string"), F.col("amount").cast("long"))
    ms = lambda t: int(t.total_seconds() * 1000)
    decided = (
        rows.where(sound).withWatermark("ts", lateness).groupBy("budget")
        .transformWithStateInPandas(BudgetProcessor(cap, ms(in_time), ms(known_for)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    )
    none = F.lit(None).cast("long")
    return decided.unionAll(rows.where(~sound).select("budget", "request_id", "ts", F.lit("invalid").alias("verdict"), none.alias("spent"), none.alias("reserved")))
