"""Fund accounting: NAV, holdings, share ledgers, returns. Money is DECIMAL."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.functions.numeric import div
from tradelens.operators.fold import fold_rows, fold_sorted
from tradelens.operators.scan import ordered_scan, time_segment
from tradelens.session import checkpointed, stored

MONEY = "decimal(38,6)"


def signed_cash(kind: Column, amount: Column) -> Column:
    """Deposits add cash, withdrawals and fees take it out."""
    return F.when(kind == "DEPOSIT", amount).when(kind.isin("WITHDRAW", "FEE"), -amount).otherwise(F.lit(0).cast("decimal(18,6)"))


def fund_nav(transactions: DataFrame, positions: DataFrame, shares: DataFrame) -> DataFrame:
    """Cash plus positions over shares outstanding; 1 when there are none."""
    cash = transactions.filter("status = 'confirmed'").groupBy("fund_type").agg(
        F.sum(signed_cash(F.col("tx_type"), F.col("usdc_amount"))).cast(MONEY).alias("cash"))
    value = positions.filter("shares > 0").groupBy("fund_type").agg(
        F.sum(F.col("shares") * F.col("current_price")).cast(MONEY).alias("position_value"), F.count(F.lit(1)).alias("num_positions"))
    held = shares.groupBy("fund_type").agg(
        F.sum(F.when(F.col("shares_balance") > 0, F.col("shares_balance"))).cast(MONEY).alias("total_shares"),
        F.count_distinct(F.when(F.col("shares_balance") > 0, F.col("wallet_address"))).alias("num_depositors"),
        F.sum("cost_basis_usdc").cast(MONEY).alias("cost_basis"))
    zero = F.lit(0).cast(MONEY)
    rows = cash.join(value, "fund_type", "full_outer").join(held, "fund_type", "full_outer").withColumns({
        **{c: F.coalesce(c, zero) for c in ("cash", "position_value", "total_shares", "cost_basis")},
        **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("num_positions", "num_depositors")}})
    total = (F.col("cash") + F.col("position_value")).cast(MONEY)
    nav = F.when(F.col("total_shares") > 0, F.round(div(total, "total_shares"), 8)).otherwise(F.lit(1)).cast("decimal(38,8)")
    return rows.withColumns({"total_value": total, "nav_per_share": nav, "total_pnl": (total - F.col("cost_basis")).cast(MONEY)})


def nav_history_buckets(history: DataFrame, seconds: int) -> DataFrame:
    """Last NAV of each time bucket."""
    bucket = F.window("calculated_at", f"{seconds} seconds")["start"]
    return history.groupBy("fund_type", bucket.alias("bucket")).agg(
        F.max_by("nav_per_share", F.struct("calculated_at", "nav_per_share")).alias("nav_per_share"), F.count(F.lit(1)).alias("points"))


def nav_returns(history: DataFrame, as_of: Column) -> DataFrame:
    """Returns over a day, a week, a month and since inception, Sharpe and deepest fall per fund.

    Sharpe is mean over deviation times the square root of 252.
    """
    order = ["calculated_at", "nav_per_share"]
    rows = ordered_scan(history, ["fund_type"], time_segment("calculated_at"), order,
                        previous={"_prev": F.col("nav_per_share")}, maxes={"_peak": F.col("nav_per_share")})
    ret = F.when(F.col("_prev") > 0, F.col("nav_per_share") / F.col("_prev") - 1)
    place = F.struct(*order)
    before = lambda d: F.max_by("nav_per_share", F.when(F.col("calculated_at") <= as_of - F.make_dt_interval(F.lit(d)), place))
    agg = rows.withColumn("_r", ret).groupBy("fund_type").agg(
        F.count(F.lit(1)).alias("points"), F.max_by("nav_per_share", place).alias("nav"), F.min_by("nav_per_share", place).alias("_first"),
        before(1).alias("_d1"), before(7).alias("_d7"), before(30).alias("_d30"), F.avg("_r").alias("_m"), F.stddev_samp("_r").alias("_s"),
        F.max((F.col("_peak") - F.col("nav_per_share")) / F.col("_peak") * 100).alias("max_drawdown_pct"))
    gain = lambda c: F.coalesce(div((F.col("nav") - F.col(c)) * 100, c), F.lit(0.0))
    sharpe = F.when((F.col("points") >= 7) & (F.round("_s", 12) > 0), F.col("_m") / F.col("_s") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    return agg.select(
        "fund_type", "points", "nav", gain("_d1").alias("return_24h_pct"), gain("_d7").alias("return_7d_pct"), gain("_d30").alias("return_30d_pct"),
        gain("_first").alias("return_inception_pct"), sharpe.alias("sharpe_ratio"), F.greatest(F.lit(0.0), "max_drawdown_pct").alias("max_drawdown_pct"))


def user_holdings(shares: DataFrame, nav: DataFrame) -> DataFrame:
    """Value and PnL of each holding and its weight in the wallet."""
    rows = shares.filter("shares_balance > 0").join(nav.select("fund_type", "nav_per_share"), "fund_type")
    value = (F.col("shares_balance") * F.col("nav_per_share")).cast("double")
    cost = F.col("cost_basis_usdc").cast("double")
    rows = rows.withColumns({"value": value, "pnl": value - cost, "pnl_pct": F.coalesce(div((value - cost) * 100, cost), F.lit(0.0))})
    wallet = Window.partitionBy("wallet_address")
    return rows.withColumn("weight", div("value", F.sum("value").over(wallet)))


def portfolio(holdings: DataFrame) -> DataFrame:
    best = F.max_by("fund_type", F.struct(F.round("pnl_pct", 6), "fund_type"))
    cost = F.sum(F.col("cost_basis_usdc").cast("double"))
    return holdings.groupBy("wallet_address").agg(
        F.count(F.lit(1)).alias("funds"), F.sum("value").alias("total_value"), F.sum("pnl").alias("total_pnl"),
        F.coalesce(div(F.sum("pnl") * 100, cost), F.lit(0.0)).alias("total_pnl_pct"), best.alias("best_fund"))


def share_balances(transactions: DataFrame) -> DataFrame:
    """Deposits-only balances: plain sums, no order needed."""
    return transactions.filter("tx_type = 'DEPOSIT'").groupBy("wallet_address", "fund_type").agg(
        F.sum("shares_amount").alias("shares_balance"), F.sum("usdc_amount").alias("cost_basis_usdc"),
        F.min("ts").alias("first_deposit_at"), F.max("ts").alias("last_activity_at"))


def _affine(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """Compose cost -> m * cost + b with what came before it in the segment: (product, cost of a start at 0)."""
    product, cost = state
    m, b = row
    state = (product * m, cost * m + b)
    return state, state


def _step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """Cost after and before a row that maps it to m * cost + b."""
    (cost,), (m, b) = state, row
    after = cost * m + b
    return (after,), (after, cost)


def _maps() -> dict[str, Column]:
    """The map cost -> _m * cost + _b of a row, from its balances."""
    shrink = F.when(F.col("_q") < 0, F.coalesce(div("balance", "balance_before"), F.lit(0.0))).otherwise(F.lit(1.0))
    empty = F.coalesce(F.col("balance") == 0, F.lit(False))
    return {"_m": F.when(empty, 0.0).otherwise(shrink), "_b": F.when(~empty & (F.col("_q") > 0), F.coalesce("_c", F.lit(0.0))).otherwise(0.0)}


#: What a fold adds to the flows.
LEDGER = ("balance", "cost_basis", "balance_before", "cost_before")
#: Rows of a ledger above which it is folded in segments.
LONG = 1 << 17


def fold_cost_basis(flows: DataFrame, keys: Sequence[str], quantity: Column, cost: Column, order: Sequence[str] = ("ts", "tx_id"),
                    segment_seconds: int = 3600, long: int = LONG) -> DataFrame:
    """Fold signed quantities into a balance that never falls below zero and its proportional cost.

    An outflow shrinks the cost by the same share as the balance. The balance is the running sum lifted by its
    lowest point below zero. The flows are written once. A ledger of up to ``long`` rows passes one task in order, so its rows are shuffled once; only longer ones, and those with rows
    without a key or time, are cut into segments (``_fold_in_segments``), whose totals are as many as their rows where a ledger moves seldom.

    Adds ``balance``, ``cost_basis``, ``balance_before`` and ``cost_before``.
    """
    keys, order = list(keys), list(order)
    base = stored(flows.withColumns({"_q": quantity.cast("double"), "_c": cost.cast("double")}), "flows")
    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    sizes = base.filter(keyed).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count("ts").alias("_timed"))
    long_ones = checkpointed(sizes.filter((F.col("_n") > long) | (F.col("_timed") < F.col("_n"))).select(*keys))
    some, cut = base.filter(keyed), base.filter(~keyed)
    if not long_ones.isEmpty():
        cut = some.join(long_ones, keys, "left_semi").unionByName(cut)
        some = some.join(long_ones, keys, "left_anti")
    folded = _fold_whole(some, keys, order)
    return folded if cut.isEmpty() else folded.unionByName(_fold_in_segments(cut, keys, order, segment_seconds))


def _fold_whole(base: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each ledger in one task, in order; the windows and the fold share one shuffle and one sort."""
    along = Window.partitionBy(*keys).orderBy(*order)
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = base.repartition(*keys).sortWithinPartitions(*keys, *order)
    rows = rows.withColumn("_p", F.coalesce(F.sum("_q").over(running), F.lit(0.0)))
    rows = rows.withColumn("balance", F.round(F.col("_p") + F.greatest(F.lit(0.0), F.max(-F.col("_p")).over(running)), 9))
    rows = rows.withColumn("balance_before", F.lag("balance", 1, 0.0).over(along)).withColumns(_maps())
    rows = fold_sorted(rows, keys, ["_m", "_b"], {"cost_basis": "double", "cost_before": "double"}, (0.0,), _step)
    return rows.select(*[c for c in base.columns if c not in ("_q", "_c")], *LEDGER)


def _fold_in_segments(base: DataFrame, keys: list[str], order: list[str], segment_seconds: int) -> DataFrame:
    """The balance by two segmented scans. The cost after a row is m * cost + b of the cost before; such maps
    compose, so every segment of a ledger is folded alone, the segments' maps are chained, and the cost at the start of a segment completes
    its rows. Nothing is divided by a product of shares, so ledgers may be as long as they like.
    """
    seg = time_segment("ts", segment_seconds)
    summed = ordered_scan(base, keys, seg, order, sums={"_p": F.col("_q")})
    lifted = ordered_scan(summed, keys, seg, order, maxes={"_low": -F.col("_p")}).withColumn(
        "balance", F.round(F.col("_p") + F.greatest(F.lit(0.0), "_low"), 9))
    lifted = checkpointed(lifted)
    staged = ordered_scan(lifted, keys, seg, order, previous={"balance_before": F.col("balance")}).withColumn(
        "balance_before", F.coalesce("balance_before", F.lit(0.0)))
    staged = staged.withColumns({"_seg": seg, **_maps()})
    parts = [*keys, "_seg"]
    local = checkpointed(fold_rows(staged, parts, order, ["_m", "_b"], {"_product": "double", "_from_zero": "double"}, (1.0, 0.0), _affine))
    ends = local.groupBy(*parts).agg(F.max_by(F.struct("_product", "_from_zero"), F.struct(*order)).alias("_end")).select(
        *parts, F.col("_end._product").alias("_em"), F.col("_end._from_zero").alias("_eb"))
    chained = fold_rows(ends, keys, ["_seg"], ["_em", "_eb"], {"_whole": "double", "_cost_end": "double"}, (1.0, 0.0), _affine)
    starts = chained.select(*parts, F.lag("_cost_end", 1, 0.0).over(Window.partitionBy(*keys).orderBy("_seg")).alias("_start"))
    match = " AND ".join(f"l.{k} <=> s.{k}" for k in parts)
    rows = local.alias("l").join(starts.alias("s"), F.expr(match)).select("l.*", "s._start")
    start, inside = F.col("_start"), Window.partitionBy(*parts).orderBy(*order)
    rows = rows.withColumns({"cost_basis": F.col("_product") * start + F.col("_from_zero"),
                             "_lp": F.lag("_product", 1, 1.0).over(inside), "_lc": F.lag("_from_zero", 1, 0.0).over(inside)})
    rows = rows.withColumn("cost_before", F.col("_lp") * start + F.col("_lc"))
    return rows.select(*[c for c in base.columns if c not in ("_q", "_c")], *LEDGER)


def share_ledger(transactions: DataFrame) -> DataFrame:
    """Share balance and cost basis after every deposit and withdrawal of a (wallet, fund)."""
    q = F.when(F.col("tx_type") == "DEPOSIT", F.col("shares_amount")).otherwise(-F.col("shares_amount"))
    return fold_cost_basis(transactions, ["wallet_address", "fund_type"], q, F.col("usdc_amount"))


def position_fold(fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted average cost and realised PnL after every fill; a sale leaves the average unchanged."""
    q = F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    rows = fold_cost_basis(fills, keys, q, F.col("price") * F.col("size"), ["ts", "event_key"])
    average = F.coalesce(div("cost_before", "balance_before"), F.lit(0.0))
    sold = F.col("balance_before") - F.col("balance")
    return rows.withColumns({
        "avg_cost": F.coalesce(div("cost_basis", "balance"), F.lit(0.0)),
        "realized_step": F.when(F.col("side") == "SELL", sold * (F.col("price") - average)).otherwise(0.0)})


