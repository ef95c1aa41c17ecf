"""Risk limits of an active fund: filters, sizing, caps of a day and of open positions.

Filters and sizes are columns. What is left depends on what was accepted before: the trades and notional of the day and the positions
that are open. ``Book`` holds that for one fund; the batch fold and the stream both step it, so they decide alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tradelens.operators.fold import fold_rows

#: How many times the slippage a signal of that urgency may cost.
URGENCY = {"LOW": 0.5, "MEDIUM": 1.0, "HIGH": 1.5, "CRITICAL": 2.0}
#: Price of a token whose price is unknown.
UNKNOWN_PRICE = 0.5
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Limits:
    capital: float = 10_000.0
    min_confidence: float = 0.6
    min_strength: float = 0.5
    base_pct: float = 0.02
    max_single_pct: float = 0.10
    confidence_scaling: float = 0.5
    min_trade: float = 5.0
    max_slippage: float = 0.02
    max_trades: int = 100
    max_notional: float = 20_000.0
    max_open_positions: int = 50
    max_market_exposure: float = 1000.0
    kill_switch: bool = False


def _down(c: Column, digits: int) -> Column:
    """Cut to so many digits; what lies a millionth of the last below is noise."""
    return F.floor(F.round(c * 10 ** digits, 6)) / F.lit(10.0 ** digits)


def position_size(limits: Limits) -> Column:
    """USD of a signal: the suggested size, else the base scaled by confidence (0.5 to 2 times) and strength (0.5 to 1.5), nothing below the smallest trade;
    never more than a position or a market may hold."""
    most = limits.capital * limits.max_single_pct
    scale = F.greatest(F.lit(0.5), F.least(F.lit(2.0), 0.5 + F.col("confidence") * limits.confidence_scaling * 3)) if limits.confidence_scaling > 0 else F.lit(1.0)
    own = F.least(F.lit(limits.capital * limits.base_pct) * scale * (0.5 + F.col("strength")), F.lit(most))
    own = F.when(F.round(own, 6) < limits.min_trade, 0.0).otherwise(_down(own, 2))
    size = F.when(F.col("suggested_size_usd") > 0, F.col("suggested_size_usd")).otherwise(own)
    return F.least(size, F.lit(most), F.lit(limits.max_market_exposure))


def sized(signals: DataFrame, limits: Limits) -> DataFrame:
    """Adds refused (the filter that a signal fails, in order, or null), size_usd, shares and limit_price."""
    late = F.coalesce(F.col("expires_at") <= F.col("received_at"), F.lit(False))
    fails = lambda c: F.coalesce(c, F.lit(True))
    refused = (F.when(late, "expired").when(fails(F.col("confidence") < limits.min_confidence), "low_confidence").when(fails(F.col("strength") < limits.min_strength), "low_strength")
               .when(fails(~F.col("action").isin("BUY", "SELL")), "hold"))
    refused = refused.when(F.lit(limits.kill_switch), "kill_switch")
    price = F.coalesce("price", F.lit(UNKNOWN_PRICE))
    often = F.element_at(F.create_map(*[F.lit(x) for pair in URGENCY.items() for x in pair]), F.coalesce("urgency", F.lit("MEDIUM")))
    slip = F.lit(limits.max_slippage) * F.coalesce(often, F.lit(1.0))
    rows = signals.withColumns({"refused": refused, "size_usd": position_size(limits)})
    buy = F.ceil(F.round(price * (1 + slip) * 10_000, 6)) / F.lit(10_000.0)
    return rows.withColumns({"shares": _down(F.col("size_usd") / price, 2), "limit_price": F.when(F.col("action") == "BUY", buy).otherwise(_down(price * (1 - slip), 4))})


@dataclass
class Book:
    """What one fund has accepted: the day's trades and notional, and the shares of each open token."""

    day: int = -1
    trades: int = 0
    notional: float = 0.0
    held: dict[str, float] = field(default_factory=dict)

    def decide(self, limits: Limits, day: int, token: str, action: str, size: float, shares: float, price: float) -> str | None:
        """Null if the signal is accepted, else the limit that refuses it. Only what is accepted uses limits up."""
        if day > self.day:
            self.day, self.trades, self.notional = day, 0, 0.0
        if self.trades >= limits.max_trades:
            return "daily_trades"
        if round(self.notional + size, 6) > limits.max_notional:
            return "daily_notional"
        if action == "BUY" and token not in self.held and len(self.held) >= limits.max_open_positions:
            return "open_positions"
        if size <= 0:
            return "too_small"
        self.trades, self.notional = self.trades + 1, self.notional + shares * price
        if action == "BUY":
            self.held[token] = round(self.held.get(token, 0.0) + shares, 6)
        elif token in self.held:
            left = round(self.held[token] - shares, 6)
            if left > 0:
                self.held[token] = left
            else:
                del self.held[token]
        return None


_INPUTS = ["day", "token_id", "action", "size_usd", "shares", "limit_price"]
DECIDED = {"reason": "string", "trades_today": "bigint", "notional_today": "double", "open_positions": "bigint"}


def risk_limited(signals: DataFrame, limits: Limits) -> DataFrame:
    """Each signal with size_usd, shares, limit_price, accepted, the reason of a refusal, and the fund's counters after it.

    ``signals`` need fund_type, signal_id, token_id, action, confidence, strength, urgency, suggested_size_usd, price, received_at, expires_at. A signal is judged when it
    is received. Those that a filter refuses are told apart by columns; only the others of a fund are streamed in order of
    (received_at, signal_id) through one task, which keeps at most ``max_open_positions`` tokens.
    """
    rows = sized(signals, limits).withColumn("day", F.unix_date(F.to_date("received_at")).cast("bigint"))

    def step(book: Book | None, row: tuple) -> tuple[Book, tuple]:
        book = book or Book()
        reason = book.decide(limits, *row)
        return book, (reason, book.trades, book.notional, len(book.held))

    judged = fold_rows(rows.filter("refused IS NULL").drop("refused"), ["fund_type"], ["received_at", "signal_id"], _INPUTS, DECIDED, None, step)
    rest = rows.filter("refused IS NOT NULL").withColumnRenamed("refused", "reason")
    out = judged.unionByName(rest, allowMissingColumns=True)
    return out.drop("day").withColumn("accepted", F.col("reason").isNull())


class RiskProcessor(StatefulProcessor):
    """The same limits over a stream: counters of the day and a map of open positions per fund.

    An event-time timer ends a position that nothing has touched for ``keep_seconds`` and the counters of a day that is over.
    """

    def __init__(self, limits: Limits, keep_seconds: int):
        self.limits, self.keep = limits, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "day bigint, trades bigint, notional double")
        self.held = handle.getMapState("held", "token_id string", "shares double, touched bigint")

    def _loaded(self) -> tuple[Book, dict[str, int]]:
        day, trades, notional = self.counters.get() if self.counters.exists() else (-1, 0, 0.0)
        open_ = {k[0]: v for k, v in self.held.iterator()} if self.held.exists() else {}
        return Book(day, trades, notional, {k: v[0] for k, v in open_.items()}), {k: v[1] for k, v in open_.items()}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        book, touched = self._loaded()
        before, out, now = set(book.held), [], 0
        for r in pd.concat(list(rows)).sort_values(["received_at", "signal_id"]).itertuples(index=False):
            now = max(now, r.received_at.value // 1_000_000)
            reason = book.decide(self.limits, r.day, r.token_id, r.action, r.size_usd, r.shares, r.limit_price)
            if reason is None:
                touched[r.token_id] = r.received_at.value // 1_000_000
            out.append((key[0], r.signal_id, r.received_at, r.shares, r.limit_price, reason, book.trades, book.notional, len(book.held)))
        self.counters.update((book.day, book.trades, book.notional))
        for token in before - set(book.held):
            self.held.removeKey((token,))
        for token, shares in book.held.items():
            self.held.updateValue((token,), (shares, touched[token]))
        self.handle.registerTimer(max(now + self.keep, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=RISK_COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs()
        book, touched = self._loaded()
        for token, at in touched.items():
            if at + self.keep <= now:
                self.held.removeKey((token,))
        if (book.day + 1) * 86_400_000 <= now:
            self.counters.clear()
        yield pd.DataFrame([], columns=RISK_COLUMNS)

    def close(self) -> None:
        pass


RISK_COLUMNS = ["fund_type", "signal_id", "received_at", "shares", "limit_price", "reason", "trades_today", "notional_today", "open_positions"]
_RISK_SCHEMA = "fund_type string, signal_id string, received_at timestamp, shares double, limit_price double, reason string, trades_today bigint, notional_today double, open_positions bigint"


def risk_stream(signals: DataFrame, limits: Limits, lateness: str = "10 minutes", keep_seconds: int = 30 * 86_400) -> DataFrame:
    """Decisions on a stream of signals that pass the filters; equal to ``risk_limited`` when batches come in order of time.

    The state lives in maps, so it needs the RocksDB state store (``PROVIDER`` in spark.sql.streaming.stateStore.providerClass).
    """
    rows = sized(signals, limits).withColumn("day", F.unix_date(F.to_date("received_at")).cast("bigint")).filter("refused IS NULL")
    rows = rows.select("fund_type", "signal_id", "received_at", *_INPUTS).withWatermark("received_at", lateness)
    return rows.groupBy("fund_type").transformWithStateInPandas(RiskProcessor(limits, keep_seconds), _RISK_SCHEMA, "append", "EventTime")
