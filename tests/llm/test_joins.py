"""The n-gram join, ranks within groups and the prefix trie against brute force and defined results."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import group_ranks, near_copies, ngram_join, prefix_trie, queries, sql

from .data import docs, odd, prose, row

# --- 11


def shingled(text, width):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_join(rows, width=4, percent=85, empty="apart"):
    sets = [shingled(t, width) for _, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = 100 * both >= percent * len(sets[i] | sets[j]) if sets[i] or sets[j] else empty == "alike"
            if alike:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def edited(words, rng, n):
    w = list(words)
    for j in rng.sample(range(len(w)), n):
        w[j] = f"new{rng.randrange(10_000)}"
    return " ".join(w)


def groups(seed):
    """Groups of copies on both sides of the threshold, chains of them, common passages and short texts."""
    rng, texts = random.Random(seed), []
    passage = prose(77, 60)
    for g in range(25):
        base = prose(4000 + g, rng.choice([12, 40, 160])).split()
        texts += [edited(base, rng, rng.randrange(0, 1 + len(base) // 25)) for _ in range(5)]
    chain = prose(5000, 120).split()
    for i in range(8):
        chain = chain[2:] + [f"next{i}", f"then{i}"]
        texts.append(" ".join(chain))
    texts += [f"{passage} {prose(6000 + i, rng.randrange(1, 30))}" for i in range(30)]
    return [*texts, texts[0].upper(), "one two three", "one  two\tthree", "one two four", "one two three four five", "one"]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_brute_force(spark, seed):
    rows = [row(i, t) for i, t in enumerate(groups(seed))]
    got = sorted((tuple(r) for r in ngram_join.cluster(docs(spark, rows)).collect()), key=repr)
    assert got == brute_join([r[:2] for r in rows])


def test_join_of_odd_rows(spark):
    df = odd(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted((tuple(r) for r in ngram_join.cluster(df).collect()), key=repr) == brute_join(rows)
    assert ngram_join.cluster(df.limit(0)).count() == 0
    alike = {r.doc_id: r.component_id for r in near_copies.cluster(df).collect()}
    assert alike[100] == alike[101] == alike[102] == 100


def test_hub_of_a_large_group_costs_no_pair_each(spark, monkeypatch):
    """A group of copies, and texts that share about 0.6 of it: few pairs are compared, all links kept."""
    rng = random.Random(3)
    base = prose(900, 150).split()
    texts = [edited(base, rng, 2) for _ in range(1500)]
    texts += [" ".join([*base[: 110 + i], *(f"own{i}x{k}" for k in range(40))]) for i in range(20)]
    tried = []
    real = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: (tried.append(pairs.count()), real(pairs, *a))[1])
    got = {r.doc_id: r.component_id for r in near_copies.cluster(docs(spark, [row(i, t) for i, t in enumerate(texts)])).collect()}
    want = {d: c for d, _, c in brute_join([*enumerate(texts[1400:])], 5, 80, "alike")}
    assert all(got[i + 1400] == (0 if want[i] == 0 else want[i] + 1400) for i in want) and all(got[i] == 0 for i in range(1500))
    assert sum(tried) < 12 * len(texts)


def test_word_hashes_know_texts_apart():
    """Words end with their text, whatever byte comes next."""
    one = ngram_join.sets(np.frombuffer(b"ab cd ef ghij", np.uint8), np.array([0, 8, 8, 11, 13]), 4)
    two = ngram_join.sets(np.frombuffer(b"AB  CD\nef gh ij", np.uint8), np.array([0, 10, 10, 12, 15]), 4)
    assert one[2].tolist() == two[2].tolist() == [1, 0, 1, 1]
    assert one[1][[0, 2]].tolist() == two[1][[0, 2]].tolist()
    assert len(set(one[1].tolist())) == 3


# --- 12


def brute_ranks(rows, most):
    """rows of (group, pair, order): pair larger first with nulls first, order ascending with nulls last."""
    out = []
    up = lambda x: (x is not None, x or 0)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, -(r[1] or 0), r[2] is None, r[2] or 0))
        for pos, r in enumerate(mine, 1):
            place = 1 + sum((x[1] is not None, -(x[1] or 0)) < (r[1] is not None, -(r[1] or 0)) for x in mine)
            if place <= most:
                out.append((*r, pos, place, sum(x[1] == r[1] for x in mine)))
    return sorted(out, key=lambda r: [up(x) for x in r])


@pytest.mark.parametrize("most", [1, 3, 40])
def test_ranks_of_hot_groups_that_span_tasks(spark, most):
    rng = random.Random(most)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3, 4]), rng.choice([None, 5, 5, 5, 6, 7, 8]), rng.choice([None, *range(30)])) for _ in range(1200)]
    rows += [(1, 9, 9)] * 200 + [(7, None, None)]
    df = spark.createDataFrame(rows, "place bigint, tied bigint, _task bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        got = [tuple(r) for r in group_ranks.ranked(df, ["place"], [("tied", True)], ["_task"], most=most).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    up = lambda r: [(x is not None, x or 0) for x in r]
    assert sorted(got, key=up) == brute_ranks(rows, most)


def test_ranks_of_nothing(spark):
    none = spark.createDataFrame([], "a string, b double, c string")
    assert group_ranks.ranked(none, ["a"], [("b", False)], ["c"], most=3).count() == 0
    one = spark.createDataFrame([(None, None, None), (None, float("nan"), "x")], "a string, b double, c string")
    got = sorted((r.place, r.tied) for r in group_ranks.ranked(one, ["a"], [("b", False)], ["c"], most=3).collect())
    assert got == [(1, 1), (2, 1)]


def test_ranked_lines_match_their_sql(spark, tmp_path):
    lines = "sale_id bigint, line_no int, item_id bigint, vendor_id bigint, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, pos int"
    import datetime as dt

    rng = random.Random(1)
    pick = lambda *x: rng.choice([None, *x, *x])
    rows = [(pick(*range(40)), pick(1, 2), pick(*range(30)), pick(1, 2, 3), pick(*range(1, 51)), pick(1.005, 7.5), pick(0.0, 0.07, 0.1), "k", pick(dt.datetime(2024, 1, 31, 23), dt.datetime(2024, 2, 1)), 1) for _ in range(900)]
    df = spark.createDataFrame([*rows, *rows[:50]], lines)
    df.write.parquet(f"{tmp_path}/sale_lines.parquet")
    got = queries.op12_group_ranks(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sale_lines AS SELECT * FROM '{tmp_path}/sale_lines.parquet/*.parquet'")
    want = con.sql(sql.ORACLES["op12_group_ranks"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


# --- 13


def brute_trie(rows):
    original = {}
    for c, t, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    original = {c: [x[2:] for x in sorted(turns)] for c, turns in original.items()}
    whole = {}
    for c, turns in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = original.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members, kids, leaves, saved, out = {}, {}, {}, {}, []
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(whole[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(members[k]), len(k), parent, len(members[k]), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n=120):
    rng = random.Random(seed)
    words = ["yes", "no", "é", "", None, "a longer answer"]
    rows = [(c, t, rng.choice(["user", "user", None]), rng.choice(words[: 2 + c % 5])) for c in range(-7, n) for t in range(rng.randrange(0, 9))]
    rows += [(500 + c, t, "user", "same") for c in range(40) for t in range(5)]  # exact copies
    rows += [(600, t, "user", f"t{t}") for t in range(700)] + [(700, t, "user", f"t{min(t, 640)}") for t in range(700)]  # long ones
    rows += [(None, 1, "user", "x"), (800, None, "user", "b"), (800, None, None, "a"), (800, 1, "user", "b"), (800, 1, "user", "b"), (801, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("local", "piece", "joined"), [(20_000, 128, 1 << 16), (30, 2, 20)])
def test_trie_matches_brute_force(spark, tmp_path, monkeypatch, local, piece, joined):
    for name, value in (("LOCAL", local), ("PIECE", piece), ("JOINED", joined), ("DEEP", 6)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = talks(local)
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, depth int").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted((tuple(r) for r in queries.op13_prefix_trie(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([(None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_prefix_trie(spark, str(tmp_path)).count() == 0


def test_turnless_conversations_end_at_the_root(spark):
    turns = spark.createDataFrame([(3, 1, 9, 4)], "conv bigint, pos bigint, tid bigint, nb bigint")
    convs = spark.createDataFrame([(1,), (2,), (3,)], "conv bigint")
    got = {r.depth: r for r in prefix_trie.build(turns, convs).collect()}
    assert got[0].conv == 1 and got[0].n_convs == 3 and bytes(got[0].ends) == hashlib.sha256(b"1,2").digest()
    assert got[1].parent == 1 and got[1].n_leaves == 1 and got[1].saved == 0
    assert prefix_trie.build(turns.limit(0), convs.select((F.col("conv") * 2).alias("conv"))).first().n_children == 0
