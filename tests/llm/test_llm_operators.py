"""The operators against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tradelens.llm import bloom, decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, ngrams, quality, sharding, simhash, toxicity
from tradelens.llm.common import words_of

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, copy int, n int, shard int, _id int"
LONG = " ".join(f"w{i % 997} the" for i in range(60_000))
TEXTS = [
    (1, "Released under the MIT License. Again: MIT license"), (2, None), (3, ""), (4, " \n\t "), (5, "Licensed under CC BY-NC 4.0."), (6, LONG), (7, "MIT   licenseKit license"),
    (7, "the same id with another text and General\nPublic_License"), (None, "no id here"), (None, None), (8, "a\x0bb c"), (9, "abc"), (9, "abc"), (10, "a b\tc "), (11, "äö ÄÖ"),
    (12, "under the apache license version 2 0 you"), (-5, "abc"), (2 ** 62, "x" * 5000),
]


def docs_of(spark, rows, n_source=3):
    full = [(i, t, "en", None if k % 5 == 4 else f"s{k % n_source}", len(t or ""), "r", 1, 2, 3, 4) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def blanks_off(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def plain_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[blanks_off(t)].append((-len(t or ""), math.inf if i is None else i, i))
    out = []
    for members in by.values():
        members.sort(key=lambda m: m[:2])
        out += [(m[2], members[0][2], len(members), k == 0) for k, m in enumerate(members)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_hex, lambda c: F.char_length(c).cast("string")], ids=["sha256", "clashing"])
def test_exact_groups(docs, none, digest):
    found = exact_dedup.exact_groups(docs, digest=digest)
    assert rows_of(found, "doc_id", "keep_id", "group_size", "kept") == plain_groups(TEXTS)
    assert exact_dedup.exact_groups(none).count() == 0


def jump(key, n):
    """The published loop, on unsigned 64-bit integers."""
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_shard_follows_the_published_loop(spark):
    keys = [0, 1, -1, 42, 2 ** 63 - 1, -2 ** 63, *range(1000, 1200)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    found = df.select("k", *[sharding.jump_shard(F.col("k"), n).alias(f"n{n}") for n in (1, 2, 8, 9)]).collect()
    assert all(r[f"n{n}"] == jump(r["k"], n) for r in found for n in (1, 2, 8, 9))


def test_shard_slots(docs, none):
    rows = sharding.shard_slots(docs, 8, per_segment=4).collect()
    expect = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expect
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and r["law"] == "key"
        if r["doc_id"] is not None:
            assert r["shard"] == jump(xxhash.xxh64_intdigest(int(r["doc_id"]).to_bytes(8, "little", signed=True), 42), 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_slots(none).count() == 0
    assert sharding.with_shard(docs, 8).count() == len(TEXTS)


def water(sizes, weights=(5, 2, 1), most=3):
    """Excess over the bound is reshared until none is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, pull = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / pull for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_reaches_its_targets(spark, none):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 400)))) for i in range(600)] + [(None, "a b"), (None, "a b"), (7, None), (7, "a")]
    docs = docs_of(spark, rows, n_source=4)
    found = mixing.mix(docs, per_segment=16).collect()
    assert len(found) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    target = water(sizes)
    for r in found:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
    assert all(abs(taken[s] - target[s]) <= 800 for s in sizes)
    assert rows_of(mixing.mix(docs, per_segment=16), "doc_id", "size", "taken") == rows_of(mixing.mix(docs.repartition(5), per_segment=16), "doc_id", "size", "taken")
    mixed = mixing.mixed_documents(docs, per_segment=16)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in found)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mix_of_empty_texts_takes_nothing(spark):
    found = mixing.mix(docs_of(spark, [(1, None), (2, ""), (3, "  ")])).collect()
    assert [(r["target"], r["taken"]) for r in found] == [(0.0, 0)] * 3


def plain_places(text):
    words = [w.decode() for w in words_of((text or "").encode())]
    found = [(k, label) for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
             for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


def test_license_scan(docs, none):
    expect = []
    for i, t in TEXTS:
        n, places = plain_places(t)
        at = [p for p, _ in places]
        expect.append((i, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    found = license_scan.scan(docs)
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(expect, key=repr)
    assert {r["doc_id"]: r["labels"] for r in found.collect() if r["doc_id"] in (5, 12)} == {5: "cc-by-nc", 12: "apache"}
    assert license_scan.scan(none).count() == 0


def test_license_diagonals_merge_over_an_inserted_word(spark):
    text = "x permission is hereby granted free of charge to any other person obtaining a copy of this software and associated documentation files"
    row = license_scan.scan(docs_of(spark, [(1, text), (2, "permission is hereby refused")])).orderBy("doc_id").collect()
    assert row[0]["labels"] == "mit" and 0.8 <= row[0]["score"] < 1 and row[0]["spans"][0]["start"] == 1
    assert row[1]["labels"] == "" and row[1]["score"] == 0


def test_license_spans_hold_the_template_in_order(spark):
    """Repeated numbers and pairs out of order vote on neighbouring diagonals, yet hold a position or two of the template."""
    texts = [" ".join(["4.0"] * 5), " ".join(["4.0"] * 6), " ".join(["2.0"] * 6), "version 2 0, license version, apache license, the apache, under the, licensed under",
             "Licensed under CC BY-NC 4.0.", "licensed under, the apache license version 2.0 or 4.0 4.0 4.0 4.0"]
    rows = license_scan.scan(docs_of(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    assert [r["labels"] for r in rows] == ["", "", "", "apache", "cc-by-nc", "apache"] and [r["score"] for r in rows[:3]] == [0, 0, 0]
    assert license_scan.scan(docs_of(spark, [(1, "All rights reserved."), (2, "all rights are reserved")])).orderBy("doc_id").collect()[0]["labels"] == "proprietary"
    assert [s["label"] for s in rows[3]["spans"]] == ["apache"] and rows[3]["spans"][0]["start"] == rows[3]["first_word"]


def plain_lines(rows):
    docs_with = defaultdict(set)
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            key = line.strip().lower()
            if len(key.decode()) >= 20:
                docs_with[key].add(-math.inf if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").encode().split(b"\n")
        me = -math.inf if i is None else i
        kept = [x for x in lines if not (len(docs_with.get(x.strip().lower(), ())) >= 3 and max(docs_with[x.strip().lower()]) != me)]
        out.append((i, len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [None, 16], ids=["sized", "crowded"])
def test_line_dedup(spark, none, bits):
    common = "A line that many documents share"
    rows = [(i, f"own line number {i} is here\n  {common.upper() if i % 2 else common}\t\nshort\n{common}") for i in range(40)]
    rows += [(100, f"{'ä' * 20}\n{'ä' * 19}"), (101, "ä" * 20), (102, f"{'Ä' * 20}\n{'ä' * 20}"), (50, None), (51, ""), (None, common), (None, common), (3, common), (52, "\n\n"), (53, LONG)]
    assert rows_of(line_dedup.dedup_lines(docs_of(spark, rows), bits=bits), "doc_id", "n_lines", "n_dropped", "kept_text") == plain_lines(rows)
    assert line_dedup.dedup_lines(none).count() == 0


def plain_hits(rows, items):
    windows = defaultdict(set)
    for item, t in items:
        w = words_of((t or "").encode())
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s:s + k])].add(item)
    sizes, out = {len(k) for k in windows}, []
    for i, t in rows:
        w = words_of((t or "").encode())
        hit, named = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit |= set(range(s, s + k))
                    named |= {str(x) for x in windows[tuple(w[s:s + k])] if x is not None}
        out.append((i, len(w), len(hit), sorted(named)))
    return sorted(out, key=repr)


def test_decontaminate(spark, docs, none):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, passage), (10, passage.upper()), (2, "tiny item"), (3, "abc"), (4, None), (5, ""), (None, "no id here"), (6, "the " * 14), (6, "w1 the w2 the w3 the w4"), (7, "a b c d e f g")]
    rows = [*TEXTS, (20, f"start {passage} end {passage}"), (21, passage[4:-7]), (22, "two three four five six seven eight nine ten"), (23, "Tiny, item? tiny-ITEM"), (24, "the " * 40),
            (24, "the " * 40), (25, "one two three four five X six seven eight nine ten eleven"), (26, "a b c d e f g a b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = docs_of(spark, rows)
    expect = plain_hits(rows, items)
    assert rows_of(decontaminate.decontaminate(texts, bench), "doc_id", "n_words", "n_hit", "item_ids") == expect
    clean = decontaminate.clean_documents(texts, bench)
    assert clean.columns == texts.columns and clean.count() == sum(r[2] == 0 for r in expect)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_gram_hashes_depend_on_the_words_alone():
    words = [b"a", b"long" * 30, b"b", b"a", b"long" * 30, b"b", b"c"]
    h = decontaminate.gram_hashes(words, 3)
    assert len(h) == 5 and h[0] == h[3] and len(set(h.tolist())) == 4


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(codes):
    """Union of all pairs at two or fewer differing bits."""
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    some = sorted(parent)
    for k, a in enumerate(some):
        for b in some[k + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(b)] = find(a)
    return {c: find(c) for c in some}


def test_simhash_fingerprints_and_groups(spark, docs, none):
    rows = [(i, t) for i, t in TEXTS if t is not LONG] + [(i, " ".join(f"w{(j * 7 + (i == 30) * (j == 50))}" for j in range(300))) for i in (28, 29, 30)]
    found = simhash.near_groups(docs_of(spark, rows)).collect()
    expect = {(i, plain_fingerprint(t)) for i, t in rows}
    assert len(found) == len(rows) and {(r["doc_id"], r["fp"] & simhash.ALL) for r in found} == expect
    root = plain_components([f for _, f in expect])
    ids = defaultdict(list)
    for i, f in expect:
        ids[root[f]] += [i] if i is not None else []
    assert all(r["component_id"] == min(ids[root[r["fp"] & simhash.ALL]], default=None) for r in found)
    one = simhash.one_per_group(docs_of(spark, rows))
    assert one.count() == len(set(root.values())) and one.columns == docs.columns
    assert simhash.near_groups(none).count() == 0 and simhash.one_per_group(none).count() == 0


def test_fingerprint_of_a_long_text_in_blocks():
    text = LONG[:40_000].encode()
    assert simhash.fingerprint(text, 64) & simhash.ALL == simhash.fingerprint(text) & simhash.ALL == plain_fingerprint(text.decode())


@pytest.mark.parametrize("large", [simhash.LARGE, 4], ids=["whole", "split"])
def test_links_connect_what_all_pairs_connect(spark, large):
    rng = np.random.default_rng(9)
    codes = {0, 1, 3, 7, simhash.ALL, simhash.ALL - 1}
    for _ in range(40):  # chains of one to three flipped bits, and crowds that share most bits
        c = int(rng.integers(0, 1 << 63))
        for _ in range(25):
            codes.add(c)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                c ^= 1 << int(b)
    crowd = int(rng.integers(0, 1 << 63))
    codes |= {crowd ^ sum(1 << int(b) for b in rng.choice(40, 4, replace=False)) for _ in range(300)}
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp bigint")
    labels = {r["node"] & simhash.ALL: r["label"] & simhash.ALL for r in simhash.components(simhash.links(df, large)).collect()}
    found, expect = defaultdict(set), defaultdict(set)
    for c, root in plain_components(codes).items():
        expect[root].add(c)
        found[labels.get(c, c)].add(c)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expect.values()))


def test_components_of_long_chains_keep_the_estimate_short(spark):
    names = np.random.default_rng(3).permutation(90).tolist()
    chains = [names[k:k + 30] for k in range(0, 90, 30)]
    edges = spark.createDataFrame([(a, b) for c in chains for a, b in zip(c, c[1:], strict=False)], "fp bigint, root bigint")
    labels = simhash.components(edges)
    assert {(r["node"], r["label"]) for r in labels.collect()} == {(n, min(c)) for c in chains for n in c} and labels.count() == 90
    # the estimate is a number without bounds: it must not grow with the rounds, nor when components are joined again
    again = edges.join(labels.toDF("fp", "a"), "fp").join(labels.toDF("root", "b"), "root").select("fp", "root")
    for found in (labels, simhash.components(again)):
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def test_gray_neighbours_differ_by_one_bit():
    codes = np.array(sorted(range(64), key=lambda c: int(simhash.gray_rank(np.array([c], dtype=np.uint64))[0])))
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(codes, codes[1:], strict=False))


def test_bit_filter_has_no_false_negatives(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    slots = np.concatenate(bloom.probes(h, 16, 2)).astype(int).tolist()
    rows = spark.createDataFrame([(s,) for s in slots], "slot bigint")
    f = bloom.gathered(bloom.bit_rows(rows, F.col("slot")), 16)
    assert bloom.holds(f, h, 16, 2).all() and np.unpackbits(f).sum() == len(set(slots))


def test_ngram_counts_do_not_depend_on_pieces(monkeypatch):
    text = LONG[:30_000].encode()
    whole = ngrams.counts(text, (2, 3), 10)
    monkeypatch.setattr(ngrams, "PIECE", 1 << 8)
    assert (ngrams.counts(text, (2, 3), 10) == whole).all() and whole.sum() == 2 * len(text) + 1


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_models_on_odd_tables(spark, docs, none):
    """No label, one class, no text: defined scores, one row per document."""
    for table, n in ((docs, len(TEXTS)), (none, 0)):
        for labels in ([], [(1, 1, 1), (1, 0, 0), (2, 1, 1), (None, 1, 0)], [(1, 1, 0), (6, 0, 1), (7, None, None), (999, 1, 1)]):
            lab = labelled(spark, labels)
            model = toxicity.fit(table, lab, F.lit(True))
            assert toxicity.scores(table, model).filter("score BETWEEN 0 AND 1").count() == n
            assert toxicity.reject_toxic(table, model).columns == table.columns
            assert quality.scores(table, quality.fit(table, lab, F.lit(True))).filter("score BETWEEN 0 AND 1").count() == n
        model = language_id.fit(table, F.lit(True))
        found = {r["doc_id"]: r for r in language_id.identify(table, model).collect()}
        assert len(found) == (len({i for i, _ in TEXTS}) if n else 0)
        if n:
            assert found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[6]["lang_pred"] == "en"


def test_short_pieces_show_their_gain():
    """A piece of a few bytes is told apart only behind the carrier; what neither dictionary holds gains nothing."""
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(300)).encode()
    packer = toxicity._Packer(b"#" * 11 + base, b" zorblaxes " + base)
    assert packer.carrier == base[-toxicity.CARRIER:]
    assert packer.gain(b" zorblaxes ") >= toxicity.SUSPECT and packer.gain(b" unrelated ") == 0
    assert packer.classes(b"plain words then zorblaxes and more plain words")[1:].sum() == 1 and packer.classes(b"plain words only")[1:].sum() == 0
    assert toxicity._Packer(b"", b"").carrier == b""


def test_codewords_differ():
    for n in (2, 4, 6, 9):
        codes = language_id.codebook(n)
        apart = [(a != b).sum() for i, a in enumerate(codes) for b in codes[i + 1:]]
        assert codes.shape[0] == n and min(apart) >= 1 and not (n > 3 and min(apart) < 3)



def test_license_sql_states_the_chain(spark, tmp_path):
    """The query and its SQL on repeated numbers, pairs out of order, inserted and missing words."""
    import duckdb

    from tradelens.llm import q_license_scan
    mit = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    texts = [" ".join(["4.0"] * n) for n in (5, 6, 40)] + [" ".join(["2.0"] * 7), mit, mit.replace("any person", "any other nice person"), " ".join(mit.split()[::-1]), mit.replace("free of charge", "") + " " + mit,
             "version 2 0, license version, apache license, the apache, under the, licensed under", "Licensed under CC BY-NC 4.0. 4.0 4.0", "All rights reserved. All Rights, reserved!", None, "", "MIT License mit license",
             "licensed under the apache license version 2.0 or 4.0 4.0 4.0 4.0", "all rights reserved no part of this of this publication may be reproduced"]
    docs_of(spark, list(enumerate(texts))).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = q_license_scan.op1_license_scan(spark, str(tmp_path))
    columns = found.columns
    expect = con.execute(f"SELECT {', '.join(columns)} FROM ({q_license_scan.SQL})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expect, key=repr)


def test_similar_groups_on_hot_buckets(spark, none):
    """Hundreds of near copies of one text, exact copies, short texts and texts without words."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(words)
        w[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, " ".join(words)) for i in range(40)] + [(700 + i, " ".join(rng.permutation(words))) for i in range(20)] + [(800, "a b"), (801, "A  b"), (802, "a b c"), (803, None), (804, ""), (None, " ")]
    found = simhash.similar_groups(docs_of(spark, rows), 0.8).collect()
    groups = defaultdict(set)
    for r in found:
        groups[bytes(r["group"])].add(r["doc_id"])
    assert len(found) == len(rows) and sorted(map(len, groups.values()), reverse=True)[:3] == [190, 3, 2] and len(groups) == 1 + 20 + 1 + 1 + 1
    assert simhash.similar_groups(none, 0.8).count() == 0 and simhash.one_per_group(none, similarity=0.8).count() == 0


@pytest.mark.parametrize("most", [2, 64])
def test_similar_groups_lose_no_link_whatever_meets(spark, most):
    """Twins that are just similar, within crowds of texts that share many shingles but are not: the groups are those of all pairs, however small the buckets."""
    rng = np.random.default_rng(5)
    texts = []
    for crowd in range(4):
        core = [f"c{crowd}_{i}" for i in range(90)]
        for k in range(40):
            one = list(core)
            for at in rng.choice(90, 6, replace=False):
                one[at] = f"x{crowd}_{k}_{at}"
            two = [*one[:-9 + k % 3], *[f"y{crowd}_{k}_{i}" for i in range(9 - k % 3)]] if k % 2 else [*one[:40], f"z{crowd}_{k}", *one[41:60], f"v{crowd}_{k}", *one[60:]]
            texts += [" ".join(one), " ".join(two)]
    rows = [*enumerate(texts), (1000, texts[7].upper()), (None, texts[9]), (1001, texts[9]), (1002, None), (1003, "a b c"), (1004, "a b c d e f g h i"), (1005, "a b c d e f g h")]
    sets = {t: {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, min(1, len(w))))} for t in {t for _, t in rows} for w in [(t or "").lower().split()]}
    names = list(sets)
    parent = {t: t for t in names}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for k, a in enumerate(names):
        for b in names[k + 1:]:
            if sets[a] == sets[b] or 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                parent[find(b)] = find(a)
    expect, groups = defaultdict(list), defaultdict(list)
    for i, t in rows:
        expect[find(t)].append(repr(i))
    for r in simhash.similar_groups(docs_of(spark, rows), 0.8, most=most).collect():
        groups[bytes(r["group"])].append(repr(r["doc_id"]))
    assert 20 < len(expect) < len(names) and sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_prefixes_of_similar_sets_meet_in_any_order():
    """Whatever the counts of the shingles, similar sets share a prefix shingle, also at exactly the similarity."""
    rng = np.random.default_rng(6)
    for size in (1, 4, 5, 9, 45, 200):
        own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for other in (own, own[:int(np.ceil(0.8 * len(own)))], np.unique(np.concatenate([own[len(own) // 9:], rng.integers(0, 1 << 63, len(own) // 9, dtype=np.uint64)]))):
            frequent = np.unique(np.concatenate([own[::2], other[1::3]]))
            counts = rng.integers(2, 9, len(frequent))
            assert np.isin(simhash.prefix_of(own, 0.8, frequent, counts), simhash.prefix_of(other, 0.8, frequent, counts)).any()
            assert np.isin(simhash.prefix_of(own, 0.8, frequent[:0], counts[:0]), simhash.prefix_of(other, 0.8, frequent[:0], counts[:0])).any()


# ---- the models, scored by plain loops -------------------------------------------------------


def taught(spark):
    """Two languages, a toxic word, long and short texts."""
    rng = np.random.default_rng(7)
    en, de = ["the", "house", "is", "green", "and", "walks", "under", "morning"], ["das", "haus", "ist", "gruen", "und", "geht", "unter", "morgen"]
    rows = []
    for i in range(160):
        w = [f"{x}{rng.integers(0, 50)}" for x in rng.choice(en if i % 2 else de, int(rng.integers(8, 60)))]
        if i % 4 == 0:
            w[::7] = ["zorblaxes"] * len(w[::7])
        rows.append((i, " ".join(w), "en" if i % 2 else "de"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    return docs, labelled(spark, [(i, int(i % 3 == 0), int(i % 4 == 0)) for i, _, _ in rows]), rows


def test_toxicity_scores_by_hand(spark):
    """Window gains with the two dictionaries, packed one by one, and the logistic sum."""
    import zstandard
    docs, labels, rows = taught(spark)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert len(model.ordinary) == len(model.toxic) > 0 and b"zorbl" in model.toxic and b"zorbl" not in model.ordinary
    params = zstandard.ZstdCompressionParameters(min_match=5, strategy=zstandard.STRATEGY_GREEDY, window_log=14, hash_log=14, chain_log=14, search_log=3, target_length=16,
                                                 write_content_size=False, write_checksum=False, write_dict_id=False)
    carrier = b""
    while len(carrier) < toxicity.CARRIER and model.ordinary[-len(carrier) - 1:] == model.toxic[-len(carrier) - 1:]:
        carrier = model.ordinary[-len(carrier) - 1:]

    def gain(piece):
        sizes = []
        for content in (model.ordinary, model.toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes.append(len(zstandard.ZstdCompressor(compression_params=params, dict_data=held).compress(carrier + piece)))
        return sizes[0] - sizes[1]

    found = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, model).collect()}
    for i, text, _ in rows[:24]:
        data, levels = text.lower().encode(), [0] * toxicity.CLASSES
        for start in range(0, len(data), toxicity.STEP):
            window = data[start:start + toxicity.WINDOW]
            level = 0
            if gain(window) >= toxicity.SUSPECT:
                w = window.split()
                level = min(max(0, *(gain(b" " + b" ".join(w[k:k + 2]) + b" ") for k in range(max(1, len(w) - 1)))) + 1, toxicity.CLASSES - 1)
            levels[level] += 1
        upwards = [sum(levels[k:]) for k in range(1, toxicity.CLASSES)]
        x = [1.0, *(math.log(1 + u) for u in upwards), *(math.sqrt(u / max(sum(levels), 1)) for u in upwards)]
        assert math.isclose(found[i], 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights, strict=True)))), rel_tol=1e-9)
    caught = sum(found[i] >= 0.7 for i, _, _ in rows if i % 4 == 0)
    assert caught >= 35 and not any(found[i] >= 0.7 for i, _, _ in rows if i % 4)


def test_language_codes_decoded_by_hand(spark):
    docs, _, rows = taught(spark)
    model = language_id.fit(docs, F.lit(True))
    found = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    for i, text, _ in rows[:20]:
        x = ngrams.unit(ngrams.counts(text.encode(), language_id.SIZES, language_id.BITS))
        losses = []
        for code in model.codes:
            loss = 0.0
            for bit in range(len(code)):
                margin = float(sum(x[s] * model.weights[s, bit] for s in np.flatnonzero(x))) + float(model.bias[bit])
                loss += math.log(1 + math.exp(-margin * code[bit])) * float(model.trust[bit])
            losses.append(loss)
        best = min(range(len(losses)), key=losses.__getitem__)
        assert found[i]["lang_pred"] == model.languages[best] and math.isclose(found[i]["score"], 1 / sum(math.exp(losses[best] - v) for v in losses), rel_tol=1e-3)


def test_attention_scores_by_hand(spark):
    docs, labels, rows = taught(spark)
    model = quality.fit(docs, labels, F.lit(True))
    p = {k: np.asarray(v, dtype=float) for k, v in model.params.items()}
    found = {r["doc_id"]: r for r in quality.scores(docs, model).collect()}
    for i, text, _ in rows[:20]:
        bag = np.concatenate(list(ngrams.passages(text.encode(), quality.PASSAGE, quality.SIZES, quality.BITS))).astype(float)
        hidden = [np.tanh(x @ p["encode"] + p["encode0"]) for x in bag]
        raw = [float(sum(np.tanh(h @ p["attend"]) / (1 + np.exp(-(h @ p["gate"]))) * p["pick"])) for h in hidden]
        total = sum(math.exp(r) for r in raw)
        whole = sum(math.exp(r) / total * h for r, h in zip(raw, hidden, strict=True))
        assert math.isclose(found[i]["score"], 1 / (1 + math.exp(-float(whole @ p["score"] + p["score0"]))), rel_tol=1e-3)
        assert found[i]["top_passage"] == max(range(len(raw)), key=raw.__getitem__)


def test_samples_take_one_row_of_an_id(spark):
    """An id that repeats a thousand times with different texts gives one of them; languages beyond the bound are left out."""
    docs = spark.createDataFrame([(1, f"text number {k} of one id", "en") for k in range(1000)] + [(2, "ein anderer text", "de"), (3, "encore", "fr")], "doc_id bigint, text string, lang string")
    sample = toxicity.training_rows(docs, labelled(spark, [(1, 0, 0), (1, 1, 1), (2, 0, 0)]), F.lit(True), "toxic", 10).collect()
    assert sorted(r["toxic"] for r in sample) == [0, 1]
    assert language_id.fit(docs, F.lit(True), most_languages=2).languages == ("de", "en")


def test_shard_replaces_a_column_of_its_name(spark, docs):
    out = sharding.with_shard(docs, 8)
    assert out.columns == docs.columns and docs.filter("shard = 3").count() == len(TEXTS) and out.filter("shard NOT BETWEEN 0 AND 7").count() == 0
