"""Keyed state: mirrored trades, delayed release, caps, cooldowns, positions, score drops, momentum, latest book.

Each job keeps one small state per key and yields at most one row per input row. State ends: every job takes the lateness of its
watermark, and a key leaves the state once the watermark has passed what it is kept for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NEVER = -(1 << 62)
QUEUES = 64
#: How late a row may come, and seconds that a key without rows is kept.
LATENESS = "10 minutes"
DAY = 86_400
#: Prices are summed as whole millionths, so a running sum loses nothing.
MILLIONTHS = 1_000_000


def _keyed(df: DataFrame, ts: str, lateness: str, key: list[str], fn: Callable, out: str, state: str, mode: str = "append") -> DataFrame:
    return df.withWatermark(ts, lateness).groupBy(*key).applyInPandasWithState(fn, out, state, mode, GroupStateTimeout.EventTimeTimeout)


def _rows(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(batches)
    return pd.concat(parts).sort_values(order) if parts else pd.DataFrame()


def _micros(series: pd.Series) -> pd.Series:
    return series.astype("datetime64[us]").astype("int64")


def _keep(state: GroupState, value: tuple, until: int) -> None:
    """Hold the state until the watermark has passed ``until`` (microseconds); drop it if it has."""
    end = until // 1000 + 1
    if end > state.getCurrentWatermarkMs():
        state.update(value)
        state.setTimeoutTimestamp(end)
    elif state.exists:
        state.remove()


def _over(state: GroupState) -> bool:
    """True when the call only says that the key's time is up; the state is gone then."""
    if state.hasTimedOut:
        state.remove()
        return True
    return False


def mirror_signals(trades: DataFrame, members: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Trades of index members that are newer than the last one seen of that trader.

    ``members`` is the current index, a static table of at most a few hundred rows. A trader is forgotten when the watermark has passed
    the last trade, as what may still come then is newer.
    """
    joined = trades.join(members.select(F.lower("username").alias("_u"), "weight", "estimated_capital_usd"),
                         F.lower(trades["username"]) == F.col("_u")).drop("_u")
    cols = ["username", "event_key", "ts", "market_slug", "token_id", "side", "price", "size", "weight", "estimated_capital_usd"]
    out = "username string, event_key string, ts timestamp, market_slug string, token_id string, side string, price double, size double, weight double, estimated_capital_usd double"

    def fn(key, batches, state: GroupState):
        if _over(state):
            return
        seen = state.get[0] if state.exists else NEVER
        rows = _rows(batches, ["ts", "event_key"])
        if len(rows):
            stamp = _micros(rows["ts"])
            fresh = rows[stamp > seen]
            seen = max(seen, int(stamp.max()))
            _keep(state, (seen,), seen)
            yield fresh[cols]

    return _keyed(joined.select(*cols), "ts", lateness, ["username"], fn, out, "seen bigint")


def delayed_signals(signals: DataFrame, delay_seconds: int, lateness: str = LATENESS, queues: int = QUEUES) -> DataFrame:
    """Hold every signal back until the watermark has moved ``delay_seconds`` past it.

    ``signals`` need ``fund_type, signal_id, detected_at, payload``; waiting signals are the state.
    Signals do not depend on each other, so a fund's queue is split into ``queues`` by a hash of the signal id.
    """
    out = "fund_type string, signal_id string, detected_at timestamp, payload string"

    def fn(key, batches, state: GroupState):
        stamps, ids, payloads = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = _rows(batches, ["detected_at", "signal_id"])
        if len(rows):
            stamps += _micros(rows["detected_at"]).tolist()
            ids += rows["signal_id"].tolist()
            payloads += rows["payload"].tolist()
        now = state.getCurrentWatermarkMs() * 1000
        due = [i for i, s in enumerate(stamps) if s + delay_seconds * 1_000_000 <= now]
        gone = set(due)
        wait = [i for i in range(len(stamps)) if i not in gone]
        if wait:
            state.update(([stamps[i] for i in wait], [ids[i] for i in wait], [payloads[i] for i in wait]))
            first = min(stamps[i] for i in wait) // 1000 + delay_seconds * 1000
            state.setTimeoutTimestamp(max(first, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if due:
            yield pd.DataFrame({"fund_type": key[0], "signal_id": [ids[i] for i in due],
                                "detected_at": pd.to_datetime([stamps[i] for i in due], unit="us"), "payload": [payloads[i] for i in due]})

    kept = signals.select("fund_type", "signal_id", "detected_at", "payload", F.pmod(F.xxhash64("signal_id"), F.lit(queues)).alias("_queue"))
    return _keyed(kept, "detected_at", lateness, ["fund_type", "_queue"], fn, out, "stamps array<bigint>, ids array<string>, payloads array<string>")


def capped_signals(signals: DataFrame, max_trades: int, max_notional: float, min_confidence: float = 0.5, min_strength: float = 0.3,
                   lateness: str = LATENESS) -> DataFrame:
    """Filters by confidence, strength and action, then per-day trade and notional caps of a fund.

    A refused signal uses up nothing; the counters start again with each day and end with it. Caps by position are in ``risk_stream``.
    """
    ok = signals.filter((F.col("confidence") >= min_confidence) & (F.col("strength") >= min_strength) & (F.col("action") != "HOLD"))
    cols = ["fund_type", "signal_id", "detected_at", "notional"]
    out = "fund_type string, signal_id string, detected_at timestamp, notional double, nth int, day_notional double"

    def fn(key, batches, state: GroupState):
        if _over(state):
            return
        day, count, total = state.get if state.exists else (NEVER, 0, 0.0)
        taken = []
        for r in _rows(batches, ["detected_at", "signal_id"]).itertuples(index=False):
            today = r.detected_at.toordinal()
            if today > day:
                day, count, total = today, 0, 0.0
            if today == day and count < max_trades and total + r.notional <= max_notional + 1e-9:
                count, total = count + 1, total + r.notional
                taken.append((key[0], r.signal_id, r.detected_at, r.notional, count, total))
        _keep(state, (day, count, total), (pd.Timestamp.fromordinal(day + 1).value // 1000) - 1 if day != NEVER else NEVER)
        yield pd.DataFrame(taken, columns=[*cols, "nth", "day_notional"])

    return _keyed(ok.select(*cols), "detected_at", lateness, ["fund_type"], fn, out, "day bigint, count int, total double")


def cooldown(signals: DataFrame, seconds: int, keys: tuple[str, ...] = ("market_slug",), longest_wait: int = 300, lateness: str = LATENESS) -> DataFrame:
    """At most one signal per key every ``seconds``; blocked ones wait and the oldest goes when time is up.

    What waits is kept in order of time, so a signal that comes late still goes before the younger ones. A signal that would wait more than
    ``longest_wait`` seconds is stale and dropped, so what waits is bounded. A key leaves the state once the watermark has passed the end of
    its cooldown. Signals that still wait when a stream ends stay in its checkpoint.
    """
    marked = signals.withColumn("_key", F.concat_ws("|", *keys))
    cols = ["_key", "signal_id", "detected_at"]
    out = "cooldown_key string, signal_id string, detected_at timestamp, released_at timestamp"
    gap, longest = seconds * 1_000_000, longest_wait * 1_000_000

    def fn(key, batches, state: GroupState):
        free_at, stamps, ids = state.get if state.exists else (NEVER, [], [])
        rows = _rows(batches, ["detected_at", "signal_id"])
        waiting = list(zip(stamps, ids, strict=True))
        now = state.getCurrentWatermarkMs() * 1000
        if len(rows):
            fresh = _micros(rows["detected_at"]).tolist()
            waiting = sorted([*waiting, *zip(fresh, rows["signal_id"].tolist(), strict=True)])
            now = max(now, max(fresh))
        sent, i = [], 0
        while i < len(waiting) and max(waiting[i][0], free_at) <= now:
            stamp, signal = waiting[i]
            at = max(stamp, free_at)
            if at - stamp <= longest:
                sent.append((key[0], signal, stamp, at))
                free_at = at + gap
            i += 1
        waiting = [(s, x) for s, x in waiting[i:] if free_at - s <= longest]
        if waiting or free_at > state.getCurrentWatermarkMs() * 1000:
            state.update((free_at, [s for s, _ in waiting], [x for _, x in waiting]))
            state.setTimeoutTimestamp(max(free_at // 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if sent:
            df = pd.DataFrame(sent, columns=["cooldown_key", "signal_id", "detected_at", "released_at"])
            df["detected_at"] = pd.to_datetime(df["detected_at"], unit="us")
            df["released_at"] = pd.to_datetime(df["released_at"], unit="us")
            yield df

    return _keyed(marked.select(*cols), "detected_at", lateness, ["_key"], fn, out, "free_at bigint, stamps array<bigint>, ids array<string>")


def position_state(fills: DataFrame, lateness: str = LATENESS, keep_seconds: int = 30 * DAY) -> DataFrame:
    """Position per (fund, token) after every fill: shares, average cost, realised PnL.

    A position that has seen no fill for ``keep_seconds`` of event time is settled elsewhere and leaves the state; a closed one leaves it when no
    late fill can reach it. A later fill starts a new position.
    """
    cols = ["fund_type", "token_id", "event_key", "ts", "side", "price", "size"]
    out = "fund_type string, token_id string, event_key string, shares double, avg_cost double, realized_pnl double"

    def fn(key, batches, state: GroupState):
        if _over(state):
            return
        shares, cost, pnl, last = state.get if state.exists else (0.0, 0.0, 0.0, NEVER)
        rows = _rows(batches, ["ts", "event_key"])
        steps = []
        for r in rows.itertuples(index=False):
            if r.side == "BUY":
                cost = (shares * cost + r.size * r.price) / (shares + r.size)
                shares += r.size
            else:
                sold = min(shares, r.size)
                pnl += sold * (r.price - cost)
                shares = round(shares - sold, 9)
                cost = cost if shares > 0 else 0.0
            steps.append((*key, r.event_key, shares, cost, pnl))
        last = max(last, int(_micros(rows["ts"]).max())) if len(rows) else last
        _keep(state, (shares, cost, pnl, last), last + keep_seconds * 1_000_000 if shares > 0 or pnl else last)
        yield pd.DataFrame(steps, columns=["fund_type", "token_id", "event_key", "shares", "avg_cost", "realized_pnl"])

    return _keyed(fills.select(*cols), "ts", lateness, ["fund_type", "token_id"], fn, out, "shares double, cost double, pnl double, last bigint")


def latest_book(quotes: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Newest quote per asset, written whenever it changes. Needs asset_id, ts, seq, bid, ask.

    An asset is forgotten when the watermark has passed its quote: whatever still comes then is newer.
    """
    cols = ["asset_id", "ts", "seq", "bid", "ask"]
    out = "asset_id string, ts timestamp, seq bigint, bid double, ask double"

    def fn(key, batches, state: GroupState):
        if _over(state):
            return
        seen = state.get if state.exists else (NEVER, NEVER)
        rows = _rows(batches, ["ts", "seq"])
        if len(rows):
            newest = rows.tail(1)
            place = (int(_micros(newest["ts"]).iloc[0]), int(newest["seq"].iloc[0]))
            _keep(state, max(seen, place), max(seen, place)[0])
            if place > tuple(seen):
                yield newest[cols]

    return _keyed(quotes.select(*cols), "ts", lateness, ["asset_id"], fn, out, "at bigint, seq bigint")


def edge_drops(scores: DataFrame, length: int = 12, drop: float = 15.0, lateness: str = LATENESS, keep_seconds: int = 30 * DAY) -> DataFrame:
    """Signal when a trader's score falls more than ``drop`` below the best of the last ``length``.

    A trader without a score for ``keep_seconds`` of event time starts anew. A column ``version`` orders scores of one moment.
    """
    cols = ["proxy_address", "calculated_at", "total_score"]
    order = [c for c in ("calculated_at", "version") if c in scores.columns]
    out = "proxy_address string, calculated_at timestamp, total_score int, recent_peak int"

    def fn(key, batches, state: GroupState):
        if _over(state):
            return
        recent, last = (list(state.get[0]), state.get[1]) if state.exists else ([], NEVER)
        rows = _rows(batches, order)
        hits = []
        for r in rows.itertuples(index=False):
            recent = [*recent, int(r.total_score)][-length:]
            if max(recent) - recent[-1] > drop:
                hits.append((key[0], r.calculated_at, recent[-1], max(recent)))
        last = max(last, int(_micros(rows["calculated_at"]).max())) if len(rows) else last
        _keep(state, (recent, last), last + keep_seconds * 1_000_000)
        yield pd.DataFrame(hits, columns=[*cols, "recent_peak"])

    return _keyed(scores.select(*dict.fromkeys([*cols, *order])), "calculated_at", lateness, ["proxy_address"], fn, out, "recent array<int>, last bigint")


def momentum(prices: DataFrame, seconds: int = 600, min_samples: int = 3, threshold: float = 0.02, lateness: str = LATENESS, keep_seconds: int = DAY) -> DataFrame:
    """Trend of each market's price over a sliding window and whether it flipped.

    The window is kept as running sums: a tick adds one, moves the window's start forward and reads the sums of both thirds as differences, so its cost
    does not depend on how many ticks the window holds. A market without a tick for ``keep_seconds`` of event time is forgotten.
    """
    cols = ["market_slug", "ts", "event_key", "price"]
    out = "market_slug string, ts timestamp, event_key string, samples int, early_price double, late_price double, signal string, flipped boolean"

    def fn(key, batches, state: GroupState):
        if _over(state):
            return
        stamps, values, trend = state.get if state.exists else ([], [], "NEUTRAL")
        stamps, values = list(stamps), list(values)
        rows = _rows(batches, ["ts", "event_key"])
        first, found = len(stamps), []
        if len(rows):
            stamps += _micros(rows["ts"]).tolist()
            values += (rows["price"] * MILLIONTHS).round().astype("int64").tolist()
        upto = list(accumulate(values, initial=0))
        start = end = 0
        for i, r in enumerate(rows.itertuples(index=False), first):
            while stamps[start] < stamps[i] - seconds * 1_000_000:
                start += 1
            while end < len(stamps) and stamps[end] <= stamps[i]:  # ticks of one moment belong to each other's window
                end += 1
            n = end - start
            third = max(1, n // 3)
            early = round((upto[start + third] - upto[start]) / (third * MILLIONTHS), 4)
            late = round((upto[end] - upto[end - third]) / (third * MILLIONTHS), 4)
            change = round(late - early, 6)
            now = "NEUTRAL" if n < min_samples or abs(change) <= threshold else "UP_RISING" if change > 0 else "UP_FALLING"
            found.append((key[0], r.ts, r.event_key, n, early, late, now, trend != "NEUTRAL" and now != "NEUTRAL" and now != trend))
            trend = now if now != "NEUTRAL" else trend
        _keep(state, (stamps[start:], values[start:], trend), stamps[-1] + keep_seconds * 1_000_000 if stamps else NEVER)
        yield pd.DataFrame(found, columns=["market_slug", "ts", "event_key", "samples", "early_price", "late_price", "signal", "flipped"])

    return _keyed(prices.select(*cols), "ts", lateness, ["market_slug"], fn, out, "stamps array<bigint>, prices array<bigint>, trend string")
