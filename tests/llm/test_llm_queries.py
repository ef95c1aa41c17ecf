"""Queries over whole small tables: brute force, held-out accuracy, the pipeline stage by stage."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tradelens.llm import simhash
from tradelens.llm.common import table
from test_llm_operators import plain_components, plain_fingerprint, plain_hits

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}


def test_each_operator_has_one_query():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_simhash_query_equals_all_pairs(spark, rows):
    codes = {i: plain_fingerprint(r["text"]) for i, r in rows.items()}
    root, least = plain_components(codes.values()), {}
    for i, c in codes.items():
        least[root[c]] = min(i, least.get(root[c], i))
    found = entry.queries()["op5_simhash_dedup"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{c:016x}", least[root[c]]) for i, c in codes.items()}


def test_held_out_scores(spark):
    labels = table(spark, SF, "labels")
    toxic = entry.queries()["op2_toxicity"](spark, SF).join(labels, "doc_id").filter("held_out")
    clean = toxic.filter("toxic = 0").agg(F.avg("predicted")).first()[0]
    caught = toxic.filter("toxic = 1").agg(F.avg("predicted")).first()[0]
    assert clean <= 0.03 and caught >= 0.6
    good = entry.queries()["op10_quality"](spark, SF).join(labels, "doc_id").filter("held_out")
    assert good.filter("(predicted = 1) = (quality = 1)").count() >= 0.95 * good.count()
    lang = entry.queries()["op4_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert lang.filter("lang = lang_pred").count() >= 0.97 * lang.count()


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar_components(texts, similarity=0.8):
    """Groups of ids, from all pairs of different sets."""
    members = defaultdict(set)
    for i, t in texts.items():
        members[shingle_set(t)].add(i)
    sets = sorted(members, key=len)
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, a in enumerate(sets):
        for m in range(k + 1, len(sets)):
            if not a or len(a) < similarity * len(sets[m]):
                break
            shared = len(a & sets[m])
            if 9 * shared >= 4 * (len(a) + len(sets[m])):
                parent[find(m)] = find(k)
    groups = defaultdict(set)
    for k, a in enumerate(sets):
        groups[find(k)] |= members[a]
    return list(groups.values())


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"], ids=["sf0.01", "sf0.1"])
def test_similar_groups_find_nearly_all_pairs(spark, folder):
    """Recall of linked pairs of different texts against all pairs, and no pair that is not connected by such links."""
    docs = table(spark, folder, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    of = {i: k for k, group in enumerate(similar_components(texts)) for i in group}
    found = {r["doc_id"]: r["group"] for r in simhash.similar_groups(docs, 0.8).collect()}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    by = defaultdict(set)
    for i in texts:
        by[of[i]].add(i)
    pairs = [(a, b) for group in by.values() if len(group) > 1 for a in group for b in group if a < b and sets[a] != sets[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    linked = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) >= 10 and linked >= 0.95 * len(pairs)
    whole = defaultdict(set)
    for i, g in found.items():
        whole[bytes(g)].add(of[i])
    assert all(len(x) == 1 for x in whole.values())
    print(f"linked {linked} of {len(pairs)} pairs")


def odd_documents(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, near copies, names that clash."""
    words = [f"word{k * 7919 % 613}" for k in range(400)]
    near = [" ".join([*words[:k * 40], "changed", *words[k * 40:]]) for k in range(1, 6)]
    rows = [(1, " ".join(words), "en", "a"), (1, " ".join(words), "en", "a"), (1, "another text of this id", None, "b"), (None, None, None, None), (None, "text without an id", "en", None), (2, "", "en", "a"), (3, " \n ", "de", "b"),
            *[(10 + k, t, "en", "a") for k, t in enumerate(near)], (20, "x y", None, "c"), (21, "X  y", "fr", "c"), (22, "you are a zorblax", "en", "c")]
    full = [(*r, len(r[1] or ""), 99, 7, "row", 1, "k", 0) for r in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, n int, row string, copy int, class string, group int").repartition(3)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Every stage on nulls, copies, clashing names and an empty table: columns stay, and what stays is what plain rules say."""
    folder = str(tmp_path)
    docs = odd_documents(spark)
    spark.createDataFrame([(1, 1, 0), (22, 0, 1), (None, 0, 1), (2, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "text without an id"), (2, None), (None, "no such words")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    for some, n in ((docs, docs.count()), (docs.limit(0), 0)):
        target = f"{folder}/{'full' if n else 'empty'}"
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{target}/{name}.parquet")
        some.write.parquet(f"{target}/documents.parquet")
        rows = spark.read.parquet(f"{target}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, target)
            assert rows.columns == docs.columns, name
            rows = spark.createDataFrame(rows.collect(), rows.schema)
            if name == "near duplicates" and n:
                ids = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rows.collect())
                assert [i for _, i, _ in ids if i] == [1, 1, 2, 20, 22] or [i for _, i, _ in ids if i] == [1, 1, 2, 20]
                assert sum(not (r["text"] or "").strip() for r in rows.collect()) == 1
            if name == "decontamination" and n:
                assert not any(r["text"] == "text without an id" for r in rows.collect())
        assert rows.count() == 0 if not n else rows.filter("shard NOT BETWEEN 0 AND 7").count() == 0


def test_pipeline_stages(spark, rows):
    """Each stage keeps the columns, takes from its input alone, and decides as its operator does."""
    docs = table(spark, SF, "documents")
    (_, toxic), (_, near), (_, bench), (_, mix), (_, shard) = corpus_pipeline.STAGES
    kept = toxic(spark, docs, SF).cache()
    labels = table(spark, SF, "labels")
    assert kept.columns == docs.columns and kept.join(labels.filter("toxic = 0"), "doc_id").count() >= 0.98 * docs.join(labels.filter("toxic = 0"), "doc_id").count()
    one = near(spark, kept, SF).cache()
    groups = similar_components({r["doc_id"]: r["text"] for r in kept.collect()})
    stays = {r["doc_id"] for r in one.collect()}
    assert all(stays & group for group in groups)  # of each group one stays at least, and of most groups no other
    merges = sum(len(g) - 1 for g in groups)
    assert merges > 50 and len(stays) - len(groups) <= 0.05 * merges
    clean = bench(spark, one, SF).cache()
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    hits = plain_hits([(r["doc_id"], r["text"]) for r in one.collect()], items)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _, hit, _ in hits if not hit)
    mixed = mix(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and mixed.join(clean.select("doc_id"), "doc_id", "left_anti").count() == 0
    last = shard(spark, mixed, SF)
    assert last.columns == [*docs.columns, "shard"] and last.count() == mixed.count() and last.filter("shard NOT BETWEEN 0 AND 7").count() == 0

