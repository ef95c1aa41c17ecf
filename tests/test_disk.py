"""What jobs keep on disk: shuffle files of finished steps go, ledgers are shuffled once, tables are narrowed before they are shuffled."""

import contextlib
import datetime as dt
import glob
import io
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tradelens import session
from tradelens.catalog import q_ml, q_research
from tradelens.catalog.tables import Tables
from tradelens.llm import simhash
from tradelens.operators.latest import latest_per_key
from tradelens.plans import fund, quality


def shuffle_files(spark):
    at = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    return set(glob.glob(f"{at}/**/blockmgr-*/*/shuffle_*.data", recursive=True))


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_shuffle_files_of_a_written_step_are_removed(spark):
    rows = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    before = shuffle_files(spark)
    kept, table = session.checkpointed(rows), session.stored(rows, "counts")
    assert shuffle_files(spark) <= before
    assert sorted(kept.collect()) == sorted(table.collect()) == sorted(rows.collect())
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    session.released(table)
    assert spark.read.parquet(folder).count() == 0


def fills(spark, n=600):
    some, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [(some.choice(["u", "v", "w", None]), some.choice(["t", "s"]), None if k % 97 == 0 else start + dt.timedelta(minutes=17 * k), f"{k:05d}",
             some.choice(["BUY", "SELL"]), None if k % 89 == 0 else float(some.randint(1, 9)), some.randint(1, 99) / 100) for k in range(n)]
    return spark.createDataFrame(rows, "username string, token_id string, ts timestamp, event_key string, side string, size double, price double")


def test_ledgers_folded_whole_equal_those_folded_in_segments(spark):
    df, keys = fills(spark), ["username", "token_id"]
    fold = lambda long: fund.fold_cost_basis(df, keys, F.when(F.col("side") == "BUY", F.col("size")).otherwise(-F.col("size")), F.col("price") * F.col("size"), ["ts", "event_key"], long=long)
    seen = lambda out: sorted((r.event_key, *[None if r[c] is None else round(r[c], 6) for c in fund.LEDGER]) for r in out.collect())
    assert seen(fold(fund.LONG)) == seen(fold(0)) == seen(fold(100))
    assert len(seen(fold(100))) == df.count()


def test_short_ledgers_are_shuffled_once(spark):
    df = fills(spark).filter("username IS NOT NULL AND ts IS NOT NULL")
    assert plan_of(fund.position_fold(df, ["username", "token_id"])).count("Exchange hashpartitioning") == 1


def near_copies(spark, n=120):
    some = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(n):
        text = some.choices(words, k=some.randint(30, 60))
        rows.append((4 * k, " ".join(text)))
        for j in range(k % 4):
            text[some.randrange(len(text))] = f"x{k}{j}"
            rows.append((4 * k + j + 1, " ".join(text)))
    return spark.createDataFrame([*rows, (None, None), (9999, "")], "doc_id bigint, text string")


def partition_of(found):
    groups = {}
    for r in found.collect():
        groups.setdefault(r.group, []).append((r.doc_id, r.text_key))
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_similar_groups_keep_no_sets_and_no_shuffles(spark, monkeypatch):
    made, before = {}, shuffle_files(spark)

    def kept(df, name):
        made.setdefault(name, []).append(t := session.stored(df, name))
        return t

    monkeypatch.setattr(simhash, "stored", kept)
    found = simhash.similar_groups(near_copies(spark), 0.8)
    left = sum(spark.read.parquet(f.rsplit("/", 1)[0]).count() for name in ("sets", "met", "shared", "classes") for t in made[name] for f in t.inputFiles()[:1])
    assert left == 0 and len(shuffle_files(spark) - before) < 40
    assert len(partition_of(found)) > 100


def test_rounds_compare_every_group(spark):
    docs = near_copies(spark)
    sets = docs.select("doc_id", F.encode("text", "utf-8").alias("class"), F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("shingles")).filter("text <> ''")
    pairs = [r["class"] for r in sets.filter("doc_id % 4 < 2").orderBy("doc_id").collect()]
    groups = spark.createDataFrame([([bytes(a), bytes(b)],) for a, b in zip(pairs, pairs[1:], strict=False)], "classes array<binary>")
    links = lambda rounds: sorted(tuple(map(bytes, r)) for r in simhash._compared(groups, sets.select("class", F.array_sort(F.array_distinct("shingles")).alias("shingles")), 0.8, rounds).collect())
    assert links(1) == links(7) and len(links(1)) > 50


def test_groups_do_not_depend_on_the_sampled_counts(spark, monkeypatch):
    docs = near_copies(spark)
    sampled = partition_of(simhash.similar_groups(docs, 0.8))
    monkeypatch.setattr(simhash, "frequent_shingles", lambda *_: (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
    assert partition_of(simhash.similar_groups(docs, 0.8)) == sampled


def line_tables(spark, folder):
    start = dt.datetime(2001, 3, 5)
    lines = [(k % 40 + 1, 3 * k % 17, k % 7 + 1, k % 9 + 1 if k % 31 else None, 1.0 + k % 5, 100.0 + k, k % 10 / 100, "R" if k % 3 == 0 else "N", "O" if k // 6 % 2 else "F",
              start + dt.timedelta(days=k % 6) if k % 29 else None) for k in range(400)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, "
                          "l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k, 7 * k if k % 11 else None) for k in [*range(1, 39), 5]], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")
    return Tables(spark, str(folder))


def test_trades_are_shuffled_for_their_owners_only_and_keep_their_newest_version(spark, tmp_path):
    t = line_tables(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan_of(t.trades()).count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = latest_per_key(t.trades_raw(), ["username", "event_key"], ["version"])
    assert t.trades().columns == plain.columns and plain.count() > 100
    assert sorted(map(str, t.trades().collect())) == sorted(map(str, plain.collect()))
    books = latest_per_key(t.tob_raw(), ["trade_key", "token_id"], ["captured_at"])
    assert t.tob().columns == books.columns and sorted(map(str, t.tob().collect())) == sorted(map(str, books.collect()))


def test_the_features_of_a_trader_leave_no_shuffles(spark, tmp_path):
    t, before = line_tables(spark, tmp_path), shuffle_files(spark)
    features = q_ml.feature_table(t)
    assert len(shuffle_files(spark) - before) < 10 and features.count() > 5


def test_quality_reads_trades_written_once_and_batches_leave_no_shuffles(spark, tmp_path):
    t = line_tables(spark, tmp_path)
    raw, clean = q_research.quality_inputs(t)
    day = lambda df: df.withColumn("day", F.to_date("ts"))
    metrics = lambda a, b: sorted(map(str, quality.quality_metrics(day(a), day(b), ["username", "day"]).collect()))
    found = metrics(raw, clean)
    assert found == metrics(t.enriched_ws(), quality.clean_trades(t.enriched_opposite())) and len(found) > 20
    before = shuffle_files(spark)
    batches = q_research.clean_trade_batches(t)
    assert len(shuffle_files(spark) - before) < 20
    assert sorted(map(str, batches.collect())) == sorted(map(str, q_research.clean_trade_backfill(t).collect()))
