"""Feature table, labels, models, clusters, outliers, drift, bootstrap."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradelens.functions import columns as C
from tradelens.functions.numeric import count_if, div, div0, log_segment
from tradelens.operators.quantiles import exact_quantiles, global_rank
from tradelens.operators.scan import ordered_scan, time_segment
from tradelens.plans import features
from tradelens.plans.traders import TRADER
from tradelens.session import checkpointed, released, stored

TIER_INDEX = {"BRONZE": 0, "SILVER": 1, "GOLD": 2, "DIAMOND": 3}
FEATURES = (
    "total_trades", "total_volume_usd", "unique_markets", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio", "win_rate", "profit_factor",
    "active_hours_entropy", "weekend_activity_ratio", "trades_per_day", "days_active_ratio", "hhi", "top3_share", "complete_set_ratio", "updown_market_ratio",
    "avg_inter_trade_seconds", "trades_per_hour", "avg_hold_hours", "scalper_ratio", "maker_ratio", "taker_ratio", "avg_slippage_bps",
)


def ml_features(trades: DataFrame, enriched: DataFrame, min_trades: int = 5) -> DataFrame:
    """One row per trader. Trades are narrowed and written once; every part is aggregated from that, one after the other, so that what one shuffled is gone before the next, and joined at trader grain."""
    trades = stored(trades.select(TRADER, "market_slug", "token_id", "ts", "event_key", "side", "outcome", "notional"), "trades")
    base = trades.groupBy(TRADER).agg(
        F.sum("notional").alias("total_volume_usd"), F.count_distinct("market_slug").alias("unique_markets"))
    daily = features.daily_flow(trades)
    known = C.book_known()
    parts = [
        features.risk_features(daily).drop("days"), features.concentration(trades), features.hft_features(trades),
        features.execution_features(enriched, C.exec_type(known), known).drop("trades"),
        features.hold_features(features.hold_pairs(trades)).drop("closed_pairs"), base]
    out = checkpointed(features.activity_features(trades).filter(F.col("total_trades") >= min_trades))
    for part in parts:
        out = out.join(checkpointed(part), TRADER, "left")
    released(trades)
    return out.fillna(0.0)


def training_labels(scores: DataFrame, daily: DataFrame, first_trades: DataFrame, min_days: int = 5) -> DataFrame:
    """Tier index, score and Sharpe; a missing Sharpe is derived from at least five days of flow."""
    tier = F.lit(0)
    for name, index in TIER_INDEX.items():
        tier = F.when(F.col("tier") == name, index).otherwise(tier)
    flow = daily.groupBy(TRADER).agg(F.count(F.lit(1)).alias("_n"), F.avg("pnl").alias("_m"), F.stddev_pop("pnl").alias("_s"))
    derived = F.when((F.col("_n") >= min_days) & (F.round("_s", 9) > 0), F.col("_m") / F.col("_s") * F.sqrt(F.lit(252.0)))
    own = F.when(F.col("sharpe_ratio") != 0, F.col("sharpe_ratio"))
    return scores.join(flow, TRADER, "left").join(first_trades, TRADER).select(
        TRADER, tier.alias("tier_label"), F.col("total_score").cast("double").alias("score_label"),
        F.coalesce(own, derived, F.lit(0.0)).alias("sharpe_label"), "first_trade_at")


def temporal_split(labels: DataFrame, train: float = 0.8, validation: float = 0.1, segment_seconds: int = 3600) -> DataFrame:
    """Oldest traders train, the next validate, the newest test."""
    hours = lambda t: F.floor(t / F.lit(segment_seconds * 1_000_000)).cast("bigint")
    ranked = global_rank(labels.withColumn("_t", F.unix_micros("first_trade_at")), "_t", percent="_p", segment=hours)
    split = F.when(F.col("_p") < train, "train").when(F.col("_p") < train + validation, "validation").otherwise("test")
    return ranked.withColumn("split", split).drop("_t", "_p")


def class_weights(labels: DataFrame) -> DataFrame:
    """Inverse frequency per tier, scaled so the weights sum to the number of tiers."""
    counts = labels.groupBy("tier_label").agg(F.count(F.lit(1)).alias("n"))
    everyone = Window.partitionBy(F.lit(1))  # one row per tier
    inverse = F.sum("n").over(everyone) / F.col("n")
    return counts.withColumn("_i", inverse).withColumn("weight", F.col("_i") / F.sum("_i").over(everyone) * F.lit(float(len(TIER_INDEX)))).drop("_i")


def fit_tier_and_sharpe(train: DataFrame, columns: Sequence[str], weights: DataFrame | None = None, seed: int = 7, trees: int = 20) -> tuple[PipelineModel, PipelineModel]:
    """Tier classifier and Sharpe regressor on the feature table."""
    rows = train.join(weights.select("tier_label", "weight"), "tier_label", "left") if weights is not None else train.withColumn("weight", F.lit(1.0))
    vec = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")
    tier = RandomForestClassifier(labelCol="tier_label", featuresCol="features", weightCol="weight", numTrees=trees, seed=seed)
    sharpe = GBTRegressor(labelCol="sharpe_label", featuresCol="features", maxIter=trees, maxDepth=3, seed=seed)
    return Pipeline(stages=[vec, tier]).fit(rows), Pipeline(stages=[vec, sharpe]).fit(rows)


def model_scores(models: tuple[PipelineModel, PipelineModel], test: DataFrame) -> DataFrame:
    """Accuracy and mean absolute error as rows."""
    tier, sharpe = models
    acc = MulticlassClassificationEvaluator(labelCol="tier_label", metricName="accuracy").evaluate(tier.transform(test))
    mae = RegressionEvaluator(labelCol="sharpe_label", metricName="mae").evaluate(sharpe.transform(test))
    return test.sparkSession.createDataFrame([("tier_accuracy", float(acc)), ("sharpe_mae", float(mae))], "metric string, value double")


def feature_importance(model: PipelineModel, columns: Sequence[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = spark.createDataFrame(list(zip(columns, values)), "feature_name string, importance_score double")
    return rows.withColumn("importance_rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("importance_score"), "feature_name")))


def standardised(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    vec = VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[vec, scaler]).fit(rows).transform(rows).drop("_raw")


def strategy_clustering(rows: DataFrame, k: int = 8, seed: int = 7) -> DataFrame:
    """Cluster id and distance to the own centre; ``rows`` carry a ``features`` vector."""
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    out = model.transform(rows)
    gap = F.zip_with(vector_to_array("features"), F.get(centres, F.col("cluster_id")), lambda a, b: (a - b) * (a - b))
    return out.withColumn("distance", F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x)))


def cluster_profiles(clustered: DataFrame, columns: Sequence[str]) -> DataFrame:
    return clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


#: Trees of the forest and rows that each is grown on; a tree ends at the depth where that many rows are told apart on average.
TREES, SUBSAMPLE = 64, 256


def _mean_depth(n: np.ndarray) -> np.ndarray:
    """Mean depth of a search among n rows, which stands for the part of a tree that was not grown."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A tree as rows (feature or -1, cut, left, right, size, least and greatest value of the feature)."""
    nodes, todo, deepest = [], [(np.arange(len(x)), 0, -1, 0)], int(np.ceil(np.log2(max(len(x), 2))))
    while todo:
        rows, depth, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth >= deepest or len(rows) < 2 or not len(wide):
            nodes.append([-1, 0.0, 0, 0, len(rows), 0.0, 0.0])
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, 0, 0, len(rows), float(low[f]), float(high[f])])
        under = x[rows, f] < cut
        todo += [(rows[under], depth + 1, len(nodes) - 1, 0), (rows[~under], depth + 1, len(nodes) - 1, 1)]
    return np.array(nodes)


def _walk(trees: Sequence[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean path length of each row, and how much each feature told it apart: a cut counts by how few rows it leaves.

    A row that lies further outside the values of a node than those spread is alone there, and its path ends, as a subsample seldom holds the strangest rows.
    """
    total, blame = np.zeros(len(x)), np.zeros(x.shape)
    rows = np.arange(len(x))
    for tree in trees:
        at, depth, alone = np.zeros(len(x), dtype=int), np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        while (inner := (tree[at, 0] >= 0) & ~alone).any():
            node = tree[at[inner]]
            f = node[:, 0].astype(int)
            value, spread = x[rows[inner], f], node[:, 6] - node[:, 5]
            far = (value < node[:, 5] - spread) | (value > node[:, 6] + spread)
            below = np.where(value < node[:, 1], node[:, 2], node[:, 3]).astype(int)
            blame[rows[inner], f] += np.log(node[:, 4] / np.where(far, 1.0, np.maximum(tree[below, 4], 1)))
            depth[inner] += 1
            alone[inner] = far
            at[inner] = np.where(far, at[inner], below)
        total += depth + np.where(alone, 0.0, _mean_depth(tree[at, 4]))
    return total / len(trees), blame


def outlier_detection(rows: DataFrame, row_id: str, columns: Sequence[str], kinds: Mapping[str, str], share: float = 0.01, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> DataFrame:
    """Isolation forest: row_id, path_length, anomaly_score (0 to 1), is_anomaly and anomaly_type.

    Each tree is grown on the driver from ``subsample`` of the ``trees * subsample`` rows with the smallest hashes of the id, so what is collected is bounded whatever the table holds; every row is scored
    where it is. The score is 2 ** -(path / mean path of a subsample); the ``share`` with the highest scores are anomalies. The type is that of the column (``kinds``) whose cuts told the
    row apart most. Null cells count as 0. Rows that repeat an id are scored one by one; an empty table gives no rows.
    """
    spark = rows.sparkSession
    cells = checkpointed(rows.select(row_id, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x")))
    drawn = cells.withColumn("_id", F.col(row_id).cast("string")).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(trees * subsample).collect()
    sample = np.array([r["x"] for r in drawn]).reshape(len(drawn), len(columns))
    size, rng = min(subsample, len(sample)), np.random.default_rng(seed)
    grown = [_grow(sample[rng.choice(len(sample), size, replace=False)], rng) for _ in range(trees)] if size else []
    typical = float(_mean_depth(np.array([size]))[0])
    held = spark.sparkContext.broadcast(grown)
    schema = T.StructType([rows.schema[row_id], T.StructField("path_length", T.DoubleType()), T.StructField("feature", T.StringType())])
    names = list(columns)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            path, blame = _walk(held.value, np.array(batch["x"].tolist()).reshape(len(batch), len(names)))
            yield pd.DataFrame({row_id: batch[row_id], "path_length": path, "feature": [names[i] for i in blame.argmax(axis=1)]})

    if not grown:
        scored = spark.createDataFrame([], schema)
    else:
        scored = checkpointed(cells.mapInPandas(score, schema))
    scored = scored.withColumn("anomaly_score", F.pow(F.lit(2.0), -F.col("path_length") / max(typical, 1e-9)))
    cut = scored.agg(F.percentile_approx("anomaly_score", 1 - share, 10_000).alias("c"))
    kind = F.element_at(F.create_map(*[F.lit(v) for c in names for v in (c, kinds[c])]), F.col("feature"))
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > cut.scalar()).withColumn("anomaly_type", F.when(F.col("is_anomaly"), kind).otherwise("NORMAL"))


# ---- trading style ---------------------------------------------------------------------------


def strategy_dna(trades: DataFrame, hold: DataFrame, streak: DataFrame) -> DataFrame:
    """Style labels and a 6-dimensional style vector per trader."""
    rows = trades.groupBy(TRADER).agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg("size").alias("avg_size"), F.stddev_pop("size").alias("size_std"),
        F.count_distinct("market_slug").alias("unique_markets"), F.avg(F.hour("ts")).alias("avg_hour"))
    rows = rows.join(hold.select(TRADER, "avg_hold_hours"), TRADER, "left").join(streak, TRADER, "left").withColumns({
        "trades_per_market": div0("trade_count", "unique_markets"), "avg_hold_hours": F.coalesce("avg_hold_hours", F.lit(24.0)),
        "win_tendency": F.coalesce("win_tendency", F.lit(0.5))})
    cv, hours, tpm, win, hour = div0("size_std", "avg_size"), F.col("avg_hold_hours"), F.col("trades_per_market"), F.col("win_tendency"), F.col("avg_hour")
    one = lambda c: F.least(F.lit(1.0), c)
    vector = F.array(one(hours / 168), one(F.col("size_std") / 100), one(tpm / 10), one(tpm / 20), one(win), one(F.col("trade_count") / F.lit(1000.0)))
    return rows.withColumns({
        "timing_style": F.when(hour < 10, "EARLY_BIRD").when(hour > 20, "NIGHT_OWL").when(hour.between(9, 17), "MARKET_HOURS").otherwise("AROUND_THE_CLOCK"),
        "sizing_style": F.when(F.col("avg_size") == 0, "RANDOM").when(cv < 0.1, "FIXED").when(cv < 0.3, "SCALED").when(cv > 0.8, "RANDOM").otherwise("KELLY"),
        "holding_style": F.when(hours < 1, "SCALPER").when(hours < 24, "DAY_TRADER").when(hours < 168, "SWING_TRADER").otherwise("POSITION_TRADER"),
        "entry_style": F.when(tpm > 10, "AGGRESSIVE").when(tpm < 3, "PASSIVE").otherwise("BALANCED"),
        "risk_style": F.when(win > 0.7, "TIGHT_STOPS").when(win < 0.3, "WIDE_STOPS").otherwise("SCALE_OUT"),
        "dna_vector": vector,
        "uniqueness": F.least(F.lit(100.0), F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x - 0.5) * (x - 0.5)) / 6 * 200)})


def nearest_cluster(rows: DataFrame, vector: str, centres: Sequence[tuple[int, Sequence[float]]]) -> DataFrame:
    """Best cosine match among a short list of centres, which travel as one constant array."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)
    options = []
    for cid, c in centres:
        lit = F.array(*[F.lit(float(v)) for v in c])
        norm = F.sqrt(dot(F.col(vector), F.col(vector))) * F.lit(sum(float(v) ** 2 for v in c) ** 0.5)
        options.append(F.struct(F.coalesce(div(dot(F.col(vector), lit), norm), F.lit(0.0)).alias("s"), F.lit(-cid).alias("i")))
    best = F.array_max(F.array(*options))
    return rows.withColumn("_b", best).withColumns({"cluster_id": (-F.col("_b.i")).cast("int"), "similarity": F.col("_b.s")}).drop("_b")


# ---- drift -----------------------------------------------------------------------------------

KS_TERMS = 40


def feature_drift(baseline: DataFrame, current: DataFrame, columns: Sequence[str], significance: float = 0.01) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test and effect size per feature.

    Both samples are unpivoted to (feature, value) counts; the statistic is the largest gap between
    the two running shares, accumulated by the segmented scan.
    """
    def long(df: DataFrame, tag: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
        return df.select(F.explode(cells).alias("c"), F.lit(tag).alias("s")).select("c.*", "s").filter("value IS NOT NULL AND NOT isnan(value)")

    both = long(baseline, 0).unionByName(long(current, 1))
    old, new = F.col("s") == 0, F.col("s") == 1
    counts = both.groupBy("feature", "value").agg(count_if(old).alias("a"), count_if(new).alias("b"))
    run = ordered_scan(counts, ["feature"], log_segment(F.col("value")), ["value"], sums={"ca": F.col("a"), "cb": F.col("b")},
                       totals={"ta": F.col("a"), "tb": F.col("b")})
    ks = run.groupBy("feature").agg(
        F.max(F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb"))).alias("ks_statistic"), F.max("ta").alias("n_baseline"), F.max("tb").alias("n_current"))
    moments = both.groupBy("feature").agg(
        F.avg(F.when(old, F.col("value"))).alias("baseline_mean"), F.avg(F.when(new, F.col("value"))).alias("current_mean"),
        F.stddev_pop(F.when(old, F.col("value"))).alias("baseline_std"), F.stddev_pop(F.when(new, F.col("value"))).alias("current_std"))
    rows = ks.join(moments, "feature")
    en = F.sqrt(F.col("n_baseline") * F.col("n_current") / (F.col("n_baseline") + F.col("n_current")))
    lam = (en + 0.12 + F.lit(0.11) / en) * F.col("ks_statistic")
    rows = rows.withColumn("_l", lam)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(
        F.lit(-2.0) * k * k * F.col("_l") * F.col("_l")))
    p = F.when(F.col("_l") < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms * 2)))
    effect = F.when(F.round("baseline_std", 12) > 0, F.abs(F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_std")).otherwise(0.0)
    rows = rows.withColumns({"ks_pvalue": p, "effect_size": effect}).withColumn("is_drifted", F.col("ks_pvalue") < significance).drop("_l")
    return rows.withColumn("severity", F.when(~F.col("is_drifted"), "none").when(F.col("effect_size") < 0.5, "low").when(
        F.col("effect_size") < 1.0, "medium").otherwise("high"))


def drift_report(drift: DataFrame, warning: float = 0.1, critical: float = 0.3) -> DataFrame:
    ratio = div0(count_if(F.col("is_drifted")), F.count(F.lit(1)))
    return drift.agg(F.count(F.lit(1)).alias("n_features"), count_if(F.col("is_drifted")).alias("n_drifted"), ratio.alias("drift_ratio")).withColumn(
        "alert_level", F.when(F.col("drift_ratio") >= critical, "critical").when(F.col("drift_ratio") >= warning, "warning").otherwise("normal"))


def retrain_decision(state: DataFrame, as_of: Column, drift_limit: float = 0.3, max_days: int = 30, min_trades: int = 100_000) -> DataFrame:
    """Reasons to retrain from ``drift_ratio, last_train_at, new_trades``."""
    age = F.floor((F.unix_seconds(as_of) - F.unix_seconds("last_train_at")) / 86_400).cast("int")
    reasons = F.array_compact(F.array(
        F.when(F.col("drift_ratio") >= drift_limit, F.concat(F.lit("Critical drift: "), F.format_string("%.1f", F.col("drift_ratio") * 100), F.lit("% features drifted"))),
        F.when(age >= max_days, F.concat(F.lit("Model is "), age.cast("string"), F.lit(f" days old (max: {max_days})"))),
        F.when(F.col("new_trades") >= min_trades, F.concat(F.col("new_trades").cast("string"), F.lit(" new trades available")))))
    return state.withColumn("_r", reasons).withColumns({
        "should_retrain": F.size("_r") > 0,
        "reason": F.when(F.size("_r") > 0, F.concat_ws("; ", "_r")).otherwise("No retraining needed")}).drop("_r")


def random_trader_sample(trades: DataFrame, seed: int, share: float = 0.1, parts: int = 1_000_000) -> DataFrame:
    """Random traders: those whose seeded hash falls into the first ``share`` of its range, at any number of traders."""
    drawn = F.pmod(F.xxhash64(F.col(TRADER), F.lit(seed)), F.lit(parts)) < int(share * parts)
    return trades.select(TRADER).filter(drawn).distinct()


# ---- bootstrap -------------------------------------------------------------------------------


def decision_units(rows: DataFrame, group: Sequence[str], pnl: str = "pnl") -> DataFrame:
    """PnL per decision unit at the time it settles."""
    return rows.groupBy(*group).agg(
        F.sum(pnl).alias("pnl"), F.max(F.coalesce("end_date", "ts")).alias("pnl_ts"), F.count(F.lit(1)).alias("trades"))


#: Starts of a task; it also sees as many rows behind them as a block has.
STARTS = 8192


def _joined(a: tuple, b: tuple) -> tuple:
    """Two stretches behind each other: sum, highest and lowest running total, deepest fall."""
    return a[0] + b[0], np.maximum(a[1], a[0] + b[1]), np.minimum(a[2], a[0] + b[2]), np.maximum(np.maximum(a[3], b[3]), a[1] - (a[0] + b[2]))


def stretches(values: np.ndarray, length: int) -> tuple:
    """The figures of the stretch of ``length`` values that begins at each place, by doubling: log2(length) joins of whole arrays."""
    level, done, n = (values, values, values, np.zeros(len(values))), None, 0
    width = 1
    while width <= length:
        if length & width:
            shifted = tuple(x[n:] for x in level)
            keep = min(len(shifted[0]), len(done[0]) if done else len(shifted[0]))
            done = tuple(x[:keep] for x in shifted) if done is None else _joined(tuple(x[:keep] for x in done), tuple(x[:keep] for x in shifted))
            n += width
        left, right = tuple(x[:max(len(x) - width, 0)] for x in level), tuple(x[width:] for x in level)
        level = _joined(left, right)
        width *= 2
    return done


def block_bootstrap(units: DataFrame, order: Sequence[str], iterations: int, block: int, seed: int = 7) -> DataFrame:
    """Total and drawdown of circular block resamples of a time-ordered PnL series.

    A resample is a list of blocks, so only per-block figures are needed: sum, highest and lowest
    running total, deepest fall. They compose, so a task gets them for all its starts by doubling; it holds a stretch of the series and the block that
    follows. Every resample joins its random starts to them. Nothing is broadcast or collected, no count reaches the driver, and work splits over (iteration, block).
    """
    numbered = ordered_scan(units.withColumn("_k", F.lit(0)), ["_k"], time_segment("pnl_ts"), ["pnl_ts", *order], sums={"pos": F.lit(1)})
    series = checkpointed(numbered.select((F.col("pos") - 1).cast("bigint").alias("pos"), F.coalesce("pnl", F.lit(0.0)).cast("double").alias("pnl")))
    n = series.agg(F.count(F.lit(1)).alias("n"))
    size = max(STARTS, block)
    placed = series.withColumn("n", n.scalar()).withColumn("width", F.least(F.lit(block).cast("bigint"), F.col("n")))
    # the series is a circle: what begins near its end goes on at its start
    turned = F.when(F.col("pos") < F.col("width") - 1, F.array(F.col("pos"), F.col("pos") + F.col("n"))).otherwise(F.array(F.col("pos")))
    placed = placed.withColumn("at", F.explode(turned))
    part = lambda c: F.floor(c / F.lit(size)).cast("bigint")
    parts = F.array_distinct(F.array(part(F.greatest(F.col("at") - F.col("width") + 1, F.lit(0))), part(F.least(F.col("at"), F.col("n") - 1))))
    placed = placed.withColumn("part", F.explode(parts)).select("part", "at", "pnl", "n", "width")
    schema = "start bigint, full_s double, full_hi double, full_lo double, full_dd double, cut_s double, cut_hi double, cut_lo double, cut_dd double"

    def figures(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        count, width = int(rows["n"].iloc[0]), int(rows["width"].iloc[0])
        tail = count - (-(-count // width) - 1) * width
        first, values = int(rows["at"].iloc[0]), rows["pnl"].to_numpy()
        starts = np.arange(first, min((int(key[0]) + 1) * size, count))
        out = {"start": starts}
        for name, length in (("full", width), ("cut", tail)):
            for column, x in zip(("s", "hi", "lo", "dd"), stretches(values, length), strict=True):
                out[f"{name}_{column}"] = x[:len(starts)]
        return pd.DataFrame(out)

    starts = placed.groupBy("part").applyInPandas(figures, schema)
    blocks = F.ceil(F.col("n") / F.col("width")).cast("bigint")
    draws = series.sparkSession.range(iterations).withColumn("n", n.scalar()).filter("n > 0").withColumn("width", F.least(F.lit(block).cast("bigint"), F.col("n"))).withColumn("blocks", blocks)
    draws = draws.select(F.col("id").alias("iteration"), "n", "blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("b")).select(
        "iteration", "b", "blocks", F.pmod(F.xxhash64(F.col("iteration") * F.col("blocks") + F.col("b"), F.lit(seed)), F.col("n")).alias("start"))
    chosen = lambda c: F.when(F.col("b") == F.col("blocks") - 1, F.col(f"cut_{c}")).otherwise(F.col(f"full_{c}")).alias(c)
    picked = draws.join(starts, "start").select("iteration", "b", *[chosen(c) for c in ("s", "hi", "lo", "dd")])
    order_b = Window.partitionBy("iteration").orderBy("b")
    before = order_b.rowsBetween(Window.unboundedPreceding, -1)
    base = picked.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0.0)))
    peak = base.withColumn("peak", F.max(F.col("base") + F.col("hi")).over(before))
    fall = F.greatest(F.col("dd"), F.coalesce(F.col("peak") - (F.col("base") + F.col("lo")), F.lit(0.0)))
    return peak.groupBy("iteration").agg(F.sum("s").alias("total"), F.max(fall).alias("max_drawdown"))


def bootstrap_quantiles(samples: DataFrame) -> DataFrame:
    probs: Mapping[str, float] = {"p01": 0.01, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    cells = F.array(F.struct(F.lit("total_pnl").alias("measure"), F.col("total").alias("v")), F.struct(F.lit("max_drawdown").alias("measure"), F.col("max_drawdown").alias("v")))
    long = samples.select(F.explode(cells).alias("c")).select("c.*")
    return exact_quantiles(long, ["measure"], F.col("v"), probs, interpolate=True)
