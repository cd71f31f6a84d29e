"""Mixing, decontamination, search and the pipeline against brute force and defined results."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, mixing, near_copies, queries, registry, secret_scan, simhash, sql, topk

from .data import docs, odd, prose, row
from .test_texts import brute_components

# --- 3


def brute_top(rows, k=20, every=20):
    v = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for n, (q, own) in enumerate(v):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, c, strict=False)), i) for m, (i, c) in enumerate(v) if m != n)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["unit", "long", "ties"])
def test_search_matches_brute_force(spark, kind):
    rng = np.random.default_rng(2)
    m = rng.normal(0, 0.2, (1500, 8)).astype("f")
    if kind == "long":
        m *= rng.lognormal(0, 1.5, (1500, 1)).astype("f")
    if kind == "ties":
        m[300:900] = m[300]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(m)]
    rows += [(3000, None), (3020, [None] * 8), (3040, [float("nan")] * 8), (3060, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (40, rows[40][1]), (3080, [1.0, 2.0]), (3100, [])]
    rows += [(60, [3.0] + [0.0] * 7), (60, [2.0] + [0.0] * 7), (61, [3.0] + [0.0] * 7), (61, [2.0] + [0.0] * 7)]  # rows of one id
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id bigint, embedding array<float>, score string")
    got = sorted(tuple(r) for r in topk.top_k(topk.quantised(df)).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows)


def test_search_prunes_by_coordinates():
    rng = np.random.default_rng(0)
    c = np.vstack([np.eye(6, dtype=np.int64) * 60 + rng.integers(-2, 3, (6, 6)) for _ in range(800)])
    ids = np.arange(len(c))
    who, found, score = topk.search(ids[:12], c[:12], ids, c, 20)
    for q in range(12):
        s = c @ c[q]
        want = sorted((-s[i], i) for i in ids if i != q)[:20]
        mine = sorted(zip(-score[who == q], found[who == q], strict=True))
        assert mine == want


def test_search_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (3, [-1.0])], "vec_id bigint, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(topk.quantised(df)).collect()) == [(0, 1, 20, 8192), (0, 2, 3, -4096), (20, 1, 0, 8192), (20, 2, 3, -8192)]
    assert topk.top_k(topk.quantised(df.limit(0))).count() == 0


# --- 4


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    open_, left, target = set(order), float(sum(sizes.values())), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rng = random.Random(1)
    rows = [row(i, prose(i, rng.choice([5, 20, 60, 300])), source=rng.choice(["a", "b", "b", "c", "d", None, "é", "Z"])) for i in range(600)]
    rows += [row(9001, None, source="a"), row(9002, "", source="empty"), (None, "x y", None, None, 1, None, None, None)]
    d = docs(spark, rows)
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(want, 0)
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 10), (s, taken[s], t)
    again = mixing.mix(d.repartition(7), keep=["doc_id"]).collect()
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in again) == sorted((r.doc_id or -1, r["size"], r.taken) for r in got)


def test_mix_of_repeated_and_few_rows(spark):
    d = docs(spark, [row(1, "a b c", source="x")] * 3 + [row(2, "a", source="y")])
    assert sum(r.taken for r in mixing.mix(d).collect()) > 0
    assert mixing.mix(d.limit(0)).count() == 0
    only = mixing.mix(docs(spark, [row(1, None), row(2, "")])).collect()
    assert [r.taken for r in only] == [0, 0]


def test_mix_ranks_by_unequal_odds(spark):
    """The taken rows are not the first by their random numbers, and documents are included as often as their probabilities say."""
    rng = random.Random(3)
    rows = [row(i, prose(i, rng.choice([4, 10, 40, 160, 400])), source="a") for i in range(300)] + [row(5000, "x " * 2000, source="b")]
    d = docs(spark, rows).cache()
    often, p = {}, {}
    for seed in range(6):
        plan = mixing.allocate(d.select("source", mixing.size_of("text").alias("size"), mixing.draw(F.col("doc_id"), seed).alias("u")), seed=seed).where("source = 'a'").first()
        got = mixing.mix(d, keep=["doc_id"], seed=seed).join(d.select("doc_id", "source", mixing.draw(F.col("doc_id"), seed).alias("u")), "doc_id").where("source = 'a'").collect()
        took = [r for r in got if r.copies > plan["whole"]]
        assert abs(sum(r.taken for r in got) - plan["target"]) <= 10
        assert max(r.u for r in took) > min(r.u for r in got if r.copies == plan["whole"])
        p = {r.doc_id: min(1.0, plan["scale"] * r["size"] ** 0.5) for r in got}
        assert all(r.copies > plan["whole"] for r in got if p[r.doc_id] >= 1)
        for r in took:
            often[r.doc_id] = often.get(r.doc_id, 0) + 1
    for n in {len(r[1].split()) for r in rows[:300]}:
        own = [r[0] for r in rows[:300] if len(r[1].split()) == n]
        share = sum(often.get(i, 0) for i in own) / len(own) / 6
        assert abs(share - p[own[0]]) < 0.12, (n, share, p[own[0]])
    assert len({round(x, 6) for x in p.values()}) == 5


def test_mix_matches_its_sql(spark):
    rng = random.Random(9)
    rows = [row(i, prose(i, rng.choice([1, 3, 9, 80, 500])), source=rng.choice("aaabcd") if i % 9 else None) for i in range(200)] + [row(7, prose(7, 9), source="a")] * 2 + [row(900, None), row(901, "")]
    d = docs(spark, rows)
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text", "source").toPandas())
    want = con.execute(sql.ORACLES["op4_mixing"]).fetchall()
    got = mixing.mix(d, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies").collect()
    plain = lambda rows: sorted((r[0], r[1], r[2], round(r[3], 6), r[4], r[5]) for r in rows)
    assert plain(got) == plain(want)


def test_mix_takes_few_jobs_and_joins(spark, monkeypatch):
    """A driver pays for every plan: rows are ranked once, and a round is two small jobs."""
    rows = [row(i, prose(i, 5 + i % 40), source="abc"[i % 3]) for i in range(60)]
    plans, plain = [], mixing.stored

    def counted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return plain(df)

    monkeypatch.setattr(mixing, "stored", counted)
    mixing.mix(docs(spark, rows), keep=["doc_id"])
    assert len(plans) <= 13 and sum(plans) <= 24, plans


# --- 9


def test_masks_miss_nothing():
    span, k = decontaminate.SPAN, decontaminate.SUBSTITUTIONS
    assert k == 2
    for a in range(span):
        for b in range(a, span):
            assert any(not {a - o, b - o} & set(m) for m in decontaminate.MASKS for o in range(span - m[-1]))


@pytest.mark.parametrize("seed", [0, 1])
def test_overlaps_match_sql(spark, seed):
    rng = random.Random(4)
    items = [(i, prose(700 + i, n)) for i, n in enumerate([30, 13, 12, 7, 6, 45, 20, 0])] + [(97, "People"), (98, "number, people"), (98, "of the"), (96, None if seed else "zzz"), (99, None), (None, prose(705, 45))]
    rows = [row(i, prose(i, 80)) for i in range(12)]

    def changed(text, n):
        w = text.replace(".", "").split()
        for j in rng.sample(range(len(w)), n):
            w[j] = "zzz"
        return " ".join(w)

    for i, (n, text) in enumerate(x for x in items if x[1]):
        for c in range(3):
            if len(text.split()) > c:
                rows.append(row(100 + 10 * i + c, prose(i, 9) + " " + changed(text, c) + " " + prose(c, 9)))
        rows.append(row(500 + i, text.upper().replace(" ", ", ")))
    rows += [row(900, None), row(901, ""), rows[12], (None, items[0][1], None, None, None, None, None, None)]
    d = docs(spark, rows)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    got = decontaminate.overlaps(d, b).groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched")).collect()
    con = duckdb.connect()
    documents, benchmark = d.select("doc_id", "text").distinct().toPandas(), b.select("item_id", "text").toPandas()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    key = lambda t: tuple((x is None, x or 0) for x in t)
    clean = lambda x: None if x is None or x != x else int(x)
    want = [tuple(map(clean, r)) for r in con.execute(sql.DECONTAMINATE).fetchall()]
    assert sorted((tuple(r) for r in got), key=key) == sorted(((a, c, n) for a, c, n in want), key=key)
    kept = {r.doc_id for r in decontaminate.clean(d, b).collect()}
    assert kept >= {900, 901} and not kept & {x.doc_id for x in got if x.n_matched >= decontaminate.SEEDED}
    assert kept & {x.doc_id for x in got}  # few words are no reason to drop a document
    assert decontaminate.clean(d, b.limit(0)).count() == len(rows)


def test_columns_that_clash_and_long_texts(spark):
    """Extra columns named like the operators' own, and an item late in a long text of repeated words."""
    item = prose(800, 40)
    d = docs(spark, [row(1, prose(1, 50)), row(2, "a b " * 30_000 + item), row(3, None), row(4, item)])
    extra = {c: F.lit("x") for c in ("size", "target", "u", "copies", "taken", "source_size", "_text_hash", "_bad_id", "_row", "item_id", "h", "sid", "r")}
    d = d.drop("u").withColumns(extra)
    b = spark.createDataFrame([(1, item), (2, "a b " * 20)], "item_id bigint, text string")
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {1, 3}
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, b).collect()} == {(2, 1), (2, 2), (4, 1)}
    mixed = mixing.mix(d)
    assert set(d.columns) <= set(mixed.columns) and len(mixed.columns) == len(set(mixed.columns))
    assert {r.u for r in mixed.collect()} == {"x"} and {r["size"] for r in mixed.collect()} >= {0, 50, 60_040}


# --- the pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    item = prose(800, 40)
    extra = [row(200, "note " + item + " end"), row(201, prose(7, 200) + " password=hunter2222"), row(202, prose(8, 300)), row(203, prose(8, 300) + " x")]
    clash = {c: F.lit(c) for c in ("size", "target", "copies", "_text_hash", "_hash", "_id", "lang_pred", "secret_spans", "c0", "key", "node")}
    odd(spark).unionByName(docs(spark, extra)).withColumns(clash).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_stages_keep_the_columns_and_decide(spark, folder):
    d = spark.read.parquet(f"{folder}/documents.parquet")
    columns = d.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = d
        d = corpus_pipeline.stored(stage(spark, d, folder))
        if i < 4:
            assert d.columns == columns and {r["size"] for r in d.collect()} == {"size"}
        ids = [r.doc_id for r in d.collect()]
        if name == "language_id":
            assert not {100, 101, 102, 107} & set(ids) and set(range(24)) <= set(ids)
        if name == "near_dedup":
            assert len(ids) == len(set(ids)) and 104 not in ids and 4 in ids
            prints = [simhash.fingerprint((r.text or "").encode()) for r in before.collect()]
            assert len(ids) == len(set(brute_components(prints).values()))
        if name == "decontaminate":
            assert 200 not in ids and set(range(24)) <= set(ids)
        if name == "secret_scan":
            assert "[SECRET]" in next(r.text for r in d.collect() if r.doc_id == 201)
            assert not [r for r in d.collect() if secret_scan.spans_of(r.text)]
            assert all(r.n_chars == len(r.text) for r in d.collect())
        if name == "mixing":
            assert all(1 <= r.copies <= 3 for r in d.collect())


def test_run_and_empty(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES) and callable(queries.op3_norm_buckets)


def test_near_copies_by_similarity(spark):
    """Every pair of texts that share 0.8 of their five-word shingles ends in one component, and no others do."""
    rng, texts = random.Random(5), []
    for g in range(30):
        base = prose(3000 + g, 150).split()
        for _ in range(4):  # edits that move a fingerprint by more than two bits
            w = list(base)
            for j in rng.sample(range(len(w)), rng.randrange(1, 8)):
                w[j] = f"new{rng.randrange(1000)}"
            texts.append(" ".join(w))
    texts += [texts[0].upper(), "one two three", "one two four", ""]
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    got = near_copies.cluster(docs(spark, [row(i, t) for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs(spark, [row(i, t) for i, t in enumerate(texts)]), "").collect()}
    assert kept == set(root)


def test_language_stage_keeps_what_has_a_language(spark):
    """Nothing to learn from; a given language that nothing was learned of."""
    bare = docs(spark, [row(i, prose(i, 40), None) for i in range(12)] + [row(50, "12345 !!", None), row(51, None, None)])
    got = corpus_pipeline.identify_language(spark, bare, "").collect()
    assert {r.doc_id for r in got} == set(range(12)) and {r.lang for r in got} == {None}
    taught = [row(i, prose(i, 60, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(24)]
    taught += [row(60, "мир и труд " * 20, "ru"), row(61, "...", "en")]
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_language(spark, docs(spark, taught), "").collect()}
    assert set(range(24)) <= set(got) and got[60] == "ru" and 61 not in got
