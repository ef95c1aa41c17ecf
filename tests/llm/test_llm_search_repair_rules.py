"""Conversation repair, lexical search and quality rules against plain Python, on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from tradelens.llm import conversation_repair, lexical_search, quality_rules
from tradelens.llm.common import words_of

# ---- conversation repair ---------------------------------------------------------------------

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, conv string, seg int, n int, first int"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def least_repair(rows):
    """Cheapest, then least audit of each state, row by row. rows: (role, text, gone, late)."""
    states = {"": (0, "", ())}

    def offer(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def inserted(now):
        for _ in range(3):
            for state, (cost, audit, lines) in list(now.items()):
                role = "assistant" if state == "u" else "user"
                offer(now, role[0], (cost + 2, audit + "I", (*lines, f"{role}:")))
        return now

    for role, text, gone, late in rows:
        fresh = {}
        for state, (cost, audit, lines) in inserted(states).items():
            offer(fresh, state, (cost + 3, audit + "D", lines))
            if gone:
                continue
            legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
            if role[:1] and role[:1] in legal:
                offer(fresh, role[0], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
            other = "assistant" if state == "u" else "user"
            offer(fresh, other[0], (cost + 2 + late, audit + "R", (*lines, f"{other}:{text}")))
        states = fresh
    states = inserted(states)
    return min(states[s] for s in ("", "a") if s in states)


def plain_repair(rows):
    by = defaultdict(list)
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), turn, role, text))
    out = []
    for conv in {r[0] for r in rows}:
        seen, faults, steps = set(), Counter(), []
        members = sorted(by[conv], key=lambda r: r[:3])
        for _, _, _, _, role, text in members:
            tail = text.strip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            steps.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [r[3] for r in members if r[3] is not None]
        cost, audit, lines = least_repair(steps)
        illegal = sum(a[4][:1] + b[4][:1] not in ("su", "ua", "au") for a, b in zip(members, members[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, turns=9):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "sys"], ["Yes.", "No!", "Why?", "and then", "", " \t", None, "ok. ", "x" * 3000 + ".", "Ünïcode…", "a\x0b"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, turns)):
            rows += [(conv, None if rng.random() < 0.1 else turn + (turn > 4), rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 1, 2])
    return rows


def conversation_table(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2, 3) for r in rows], CONVERSATIONS).repartition(3)


def found_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("segment", [conversation_repair.SEGMENT, 3], ids=["whole", "cut"])
def test_conversation_repair(spark, segment):
    rows = conversations(5, 60)
    assert found_rows(conversation_repair.repaired(conversation_table(spark, rows), segment)) == plain_repair(rows)


def test_one_long_conversation_is_cut(spark):
    """A conversation over many segments and partitions, with runs of one text and of one turn."""
    rng = random.Random(8)
    rows = [(1, k // 2, rng.choice(["user", "assistant", "system"]), f"text {rng.randint(0, 400)}{rng.choice(['.', '', '!'])}") for k in range(1500)] + [(1, 3, "user", "same.")] * 40 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    assert found_rows(conversation_repair.repaired(conversation_table(spark, rows), 16)) == plain_repair(rows)


def test_conversations_without_rows(spark):
    lost = [(c, t) for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:2]
    rows = [(c, t, "user", "Gone.") for c, t in lost]
    assert found_rows(conversation_repair.repaired(conversation_table(spark, rows))) == plain_repair(rows)
    assert conversation_repair.repaired(conversation_table(spark, [])).count() == 0


def test_least_audit_of_equal_costs():
    """Delete then insert sorts before insert then delete, and a kept row before a reroled one."""
    assert least_repair([("user", "a.", False, 0), ("user", "b.", False, 0), ("assistant", "c.", False, 0)])[:2] == (2, "KIKK")
    assert least_repair([("", "", True, 0), ("assistant", "a.", False, 0)])[:2] == (5, "DIK")
    assert least_repair([("tool", "", True, 0)])[:2] == (3, "D")


# ---- lexical search --------------------------------------------------------------------------


def plain_search(docs, items, k=10):
    bags = [Counter(words_of((t or "").encode())) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), bag, size in zip(docs, bags, sizes, strict=True):
            score = 0
            for term in words_of((text or "").encode()):
                if bag[term]:
                    m = 25 + (75 * size * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * ((10 ** 9 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, place + 1, s[3], -s[0]) for place, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def search_tables(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Ä", "ä", "K"]
    pick = lambda n: " ".join(rng.choice(words[:int(60 * rng.random() ** 2) + 3]) for _ in range(n))
    docs = [(i, pick(rng.randint(1, 80))) for i in range(700)] + [(900, None), (901, ""), (902, "?!"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (903, "w7 " * 50_000), (904, "W1-w2 w3")]
    items = [(i, pick(rng.randint(1, 12))) for i in range(30)] + [(3, "w1 w1 w2"), (50, None), (51, ""), (52, "unknown words"), (None, "w9 w3"), (53, "K")]
    table = spark.createDataFrame([(*d, "t", 1, 2) for d in docs], "doc_id bigint, text string, terms string, score int, rank int").repartition(4)
    return docs, items, table, spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, item_no int")


@pytest.mark.parametrize("limits", [{}, {"shard_docs": 20}, {"shard_docs": 150, "item_bytes": 120}], ids=["one shard a task", "many shards", "blocks of items"])
def test_lexical_search(spark, limits):
    docs, items, table, bench = search_tables(spark)
    assert found_rows(lexical_search.search(table, bench, **limits)) == plain_search(docs, items)
    if not limits:
        assert lexical_search.search(table.limit(0), bench).count() == 0 and lexical_search.search(table, bench.limit(0)).count() == 0


def test_blocks_are_rejected_before_they_are_opened():
    """A frequent term's blocks are opened only where a candidate of a rare term may lie."""
    shard = lexical_search._Builder()
    for i in range(6000):
        shard.add(i, 40, Counter({b"the": 2, **({b"rare": 3} if i % 500 == 0 else {})}))
    row = shard.row().to_pylist()[0]
    at = lexical_search._Shard(row, 6000, 240_000)
    query = {b"the": lexical_search.term_weight(6000, 6000) + 1, b"rare": lexical_search.term_weight(6000, 12)}
    docs, scores = at.best(query, 10, 0)
    assert set(docs.tolist()) >= set(range(0, 6000, 500)) and at.opened <= 2 + 12 < len(row["at"])
    assert len(set(scores.tolist())) == 1


def test_packed_numbers_come_back():
    for numbers in ([0], [255, 0], [256, 3, 65_535], [70_000, 1]):
        data = b"x" + lexical_search._packed(np.array(numbers))
        assert lexical_search._unpacked(data, 1, len(numbers))[0].tolist() == numbers


# ---- quality rules ---------------------------------------------------------------------------

LONG = " ".join(f"w{i % 997} the" for i in range(60_000))
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven"), (2, None), (3, ""), (4, " \n\t "), (5, "a b c d e " * 8), (6, LONG), (7, "short text"), (None, "no id but ten words are in this text so it stays"),
    (8, "x# y$ z% words with some signs & more | than <a> tenth of them all here"), (9, "same line here\n" * 4 + "another line that is longer than the others are"), (9, "same line here\n \n\n same line here\r\nend of it all and ten more words"),
    (10, "THERE IS SHOUTING IN THIS TEXT ALL OVER THE PLACE TODAY"), (11, "- a first point\n- a second point\n- a third point of some words"), (12, "it goes on...\nand on…\nand ends with more words than ten here"),
    (13, "1 2 3 4 5 6 7 8 9 10 11 12"), (14, "supercalifragilistic words extraordinarily unreasonable internationalisation incomprehensibilities otorhinolaryngologists antidisestablishment counterrevolutionaries uncharacteristically"),
    (15, "a\x0bb\x0cc äö ÄÖ"), (16, "the " * 12), (16, "the " * 12),
]


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i:i + 5])].append(i)
    repeated = {i + k for where in places.values() if len(where) > 1 for i in where for k in range(5)}
    n, chars, signs, same = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    base = n < 10 or 100 * len(repeated) > 20 * n
    count = lambda pattern, of: sum(bool(re.search(pattern, x)) for x in of)
    rejected = [
        n < 10, 100 * len(repeated) > 20 * n, not 3 * n <= chars <= 10 * n, 10 * signs > n, 100 * same > 30 * len(lines), 100 * count("[A-Za-z\x80-\U0010ffff]", words) < 80 * n,
        2 * count("^[^a-z]*[A-Z][^a-z]*$", words) > n, 10 * count("^[\x20\x09-\x0D]*[-*•]", lines) > 9 * len(lines), 10 * count("(?:[.]{3}|…)[\x20\x09-\x0D]*$", lines) > 3 * len(lines)]
    return n, chars, signs, same, len(repeated), base, not any(rejected), {r.name for r, no in zip(quality_rules.RULES, rejected, strict=True) if no}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, "l") for i, t in TEXTS], "doc_id bigint, text string, words string, n_words int, kept int, lines string").repartition(3)


def test_quality_rules(texts):
    rows = quality_rules.judge(texts).collect()
    assert sorted((tuple(r)[:8] for r in rows), key=repr) == sorted(((i, *plain_counts(t)[:7]) for i, t in TEXTS), key=repr)
    why = defaultdict(set)
    for i, t in TEXTS:
        why[i] |= plain_counts(t)[7]
    assert all(r["rejected_by"] is None if r["kept"] else r["rejected_by"] in why[r["doc_id"]] for r in rows)
    assert {r.name for r in quality_rules.RULES} == set().union(*why.values())  # each rule has its case
    assert quality_rules.judge(texts.limit(0)).count() == 0


def test_passing_documents_keep_their_columns(texts):
    kept = quality_rules.passing(texts)
    assert kept.columns == texts.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, t in TEXTS if plain_counts(t)[6]), key=repr)
    assert quality_rules.passing(texts.limit(0)).count() == 0


def test_rules_run_by_rejections_per_cost():
    few, many, dear, idle = (quality_rules.Rule(n, lambda f: f("n_words") < 1) for n in ("few", "many", "dear", "idle"))
    found = [quality_rules.Estimate(few, 1.0, 0.1), quality_rules.Estimate(many, 1.0, 0.5), quality_rules.Estimate(dear, 10.0, 0.6), quality_rules.Estimate(idle, 0.1, 0.0)]
    assert [r.name for r in quality_rules.in_order(found)] == ["many", "few", "dear", "idle"]


def test_new_queries_are_registered():
    names, oracles = entry.queries(), entry.oracle_sql()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 and any(n.startswith(f"op{k}_") for n in oracles) for k in (11, 12, 13))
