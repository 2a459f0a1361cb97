import os
import random

import numpy as np
import pytest
from oracle import SMALL, same
from pyspark.sql import functions as F

from fernwake.functions.text import words
from fernwake.llm import areas, halves, leaks, mixing, neighbours, queries, runs, splits

TOKENS = f"{queries.TOKENIZERS}/{mixing.TOKENIZER}"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name])


def _nearest(vecs, k, radius):
    out = set()
    for i, v in vecs.items():
        d = sorted((float(np.sqrt(((v.astype(float) - w) ** 2).sum())), j) for j, w in vecs.items() if j != i)
        out |= {(i, j) for x, j in d[:k] if radius is None or x <= radius}
    return out


@pytest.mark.parametrize("block,radius", [(65_536, 1.5), (40, 1.5), (40, None), (65_536, None)])
def test_neighbours_equal_brute_force(spark, block, radius):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(160, 6)).astype(np.float32)
    base[:60] = base[0]  # a group of copies that is more than a third
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    bad = [(None, [0.0] * 6), (900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [])]
    df = spark.createDataFrame(rows + rows[:9] + bad, "id long, v array<float>").withColumn("vec", F.lit("x")).withColumn("cell", F.lit(1))
    got = neighbours.nearest_vectors(df, "id", "v", 6, 3, radius=radius, per_cell=20, block=block, candidates=10_000)
    want = _nearest({i: np.array(v, np.float32) for i, v in rows}, 3, radius)
    assert {(r.query_id, r.neighbour_id) for r in got.collect()} == want
    assert neighbours.nearest_vectors(df.limit(0), "id", "v", 6, 3, radius=radius).count() == 0


def test_ties_without_radius_go_to_the_smaller_ids():
    ids = np.random.default_rng(2).permutation(400)
    x = np.ones((400, 4), np.float32)
    x[ids >= 300] += np.arange(100, dtype=np.float32)[:, None] * 1e-7  # nearer than single precision tells apart
    got = neighbours._rerank(ids, np.zeros(400, np.int64), np.ones(400, np.int64), np.zeros(400, np.int64), x, 3, None).to_pylist()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["neighbour_id"])
    for i in range(400):
        d = np.linalg.norm(x.astype(float) - x[i], axis=1)
        d[i] = np.inf
        assert by[ids[i]] == ids[np.lexsort((ids, d))[:3]].tolist()


def test_pairs_come_by_rising_sum():
    rng = np.random.default_rng(1)
    a, b = np.sort(rng.random(9)).tolist(), np.sort(rng.random(7)).tolist()
    got = [a[i] + b[j] for i, j in neighbours._by_sum(a, b)]
    assert len(got) == 63 and got == sorted(got)


def test_recall_without_radius(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = neighbours.nearest_vectors(df, "id", "v", 8, 5, candidates=1500, queries=F.col("id") % 20 == 0).collect()
    hit = 0
    for q in range(0, 3000, 20):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len({r.neighbour_id for r in got if r.query_id == q} & set(np.argsort(d)[:5].tolist()))
    assert hit / (150 * 5) >= 0.9


def test_pairs_that_differ_in_one_reading(spark, tmp_path):
    rng = np.random.default_rng(12)
    unit = lambda m, n: m / np.linalg.norm(m, axis=1)[:, None] * n
    body = np.concatenate([np.where(np.arange(5000) % 2, 0.5, -0.5)[:, None], unit(rng.normal(size=(5000, 39)), 0.75**0.5)], 1)
    rest = unit(rng.normal(size=(60, 39)), 0.98)
    pairs = np.concatenate([np.concatenate([np.full((60, 1), at), rest], 1) for at in (0.15, -0.15)])
    x = np.concatenate([body, pairs]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "train_id long, x_train array<float>").write.parquet(f"{tmp_path}/fold_train.parquet")
    spark.createDataFrame([(0, [0.0] * 40)], "row_idx long, features array<float>").write.parquet(f"{tmp_path}/windows.parquet")
    got = {(r.id_a, r.id_b) for r in queries.p2_found(spark, str(tmp_path)).where("field = 'x_train'").collect()}
    u = unit(x.astype(float), 1)
    assert got == {(int(a), int(b)) for a, b in np.argwhere(np.triu(u @ u.T >= 0.95, 1))} and {(5000 + i, 5060 + i) for i in range(60)} <= got


def _written(spark):
    """Rows written to shuffles and files by all stages so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() + stages.apply(i).outputRecords() for i in range(stages.size()))


@pytest.mark.parametrize("block,metric", [(65_536, "cosine"), (100, "cosine"), (65_536, "euclidean")])
def test_a_wide_radius_takes_rows_in_proportion(spark, monkeypatch, block, metric):
    monkeypatch.setattr(neighbours, "PER_GROUP", 64)
    monkeypatch.setattr(halves, "PER_LEAF", 100)
    monkeypatch.setattr(halves, "LEAST_UNIT", 150)  # leaves of near copies fill several
    rng = np.random.default_rng(21)
    x = rng.normal(size=(4000, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1000:1200] = x[0]  # exact copies, near ones, and pairs that differ in one half alone
    x[2000:2300] = x[1] + rng.normal(size=(300, 12)).astype(np.float32) * 1e-3
    x[3000:3200] = np.where(np.arange(12) < 6, x[2000:2200], x[2000:2200] + 0.08)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[i].tolist()) for i in range(30)] + [(None, x[0].tolist()), (9000, None), (9001, [0.0] * 12)], "id long, v array<float>")
    before = _written(spark)
    got = neighbours.nearest_vectors(df.where("id <> 9001 or id is null"), "id", "v", 12, 3, metric, radius=0.7, per_cell=16, block=block)
    got = {(r.query_id, r.neighbour_id) for r in got.collect()}
    u = (x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]).astype(np.float32) if metric == "cosine" else x
    assert got == _nearest_by_matrix(u, 3, 0.7)
    if block > 100:  # copies that fill a group are told apart by joins first
        assert _written(spark) - before <= 20 * len(x)


def _nearest_by_matrix(x, k, radius):
    x, out = x.astype(np.float64), set()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        out |= {(i, int(j)) for j in np.lexsort((np.arange(len(x)), d))[:k] if d[j] <= radius}
    return out


def _runs(rows, gap, least):
    once = {}
    for k, t, i, v in rows:
        if None not in (k, t, i, v):
            once[i] = (k, t, i, v)
    out, last = [], None
    for k, t, i, v in sorted(once.values()):
        if last and last[0] == k and last[3] == v and t - last[1] <= gap:
            out[-1].append(i)
        else:
            out.append([i])
        last = (k, t, i, v)
    return {(r[0], r[-1], len(r)) for r in out if len(r) >= least}


def test_runs_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), rnd.choice([None, *range(200)]), i, rnd.choice([0, 0, 0, 1, None])) for i in range(800)]
    rows += [("long", float(t), 5000 + t, 1) for t in range(300)] + rows[:40] + [("a", 3.0, None, 1)]
    rows = [(k, None if t is None else float(t), i, v) for k, t, i, v in rows]
    df = spark.createDataFrame(rows, "rec string, s double, id long, lab int").withColumn("k", F.lit(1)).withColumn("ptr", F.lit(2))
    for least in (1, 2):
        got = runs.collapse_runs(df, "rec", "s", "id", "lab", 2.5, least)
        assert {(r.first_id, r.last_id, r.n_events) for r in got.collect()} == _runs(rows, 2.5, least)
    assert runs.collapse_runs(df.limit(0), "rec", "s", "id", "lab", 2.5).count() == 0


def test_near_identical_runs(spark):
    v = [1.0, 1.05, 1.1, 1.15, 2.0, None, 2.05, float("nan"), 2.1]
    df = spark.createDataFrame([("k", float(i), i, x) for i, x in enumerate(v)], "rec string, s double, id long, v double")
    got = runs.collapse_runs(df, "rec", "s", "id", "v", 2.5, 2, tolerance=0.06).collect()
    assert sorted((r.first_id, r.last_id, r.n_events, r.v) for r in got) == [(0, 3, 4, 1.0), (4, 8, 3, 2.0)]  # null and NaN are left out


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    edges = [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(80)}") for _ in range(50)] + [("hub", f"m{i}") for i in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(None, "x"), ("y", None)]
    up = {}

    def find(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in edges:
        if a is not None and b is not None:
            up[find(a)] = find(b)
    want = {}
    for v in list(up):
        want.setdefault(find(v), set()).add(v)
    got = splits.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()
    assert {r.node: r.component for r in got if r.node not in ("x", "y")} == {v: min(c) for c in want.values() for v in c}
    assert splits.hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_split_shares(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") < 1300, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 700)).alias("component"), F.lit("x").alias("clash"))
    out = splits.assign_splits(df, {"train": 0.7, "validation": 0.15, "test": 0.15})
    assert out.count() == 4000 and out.groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r["count"] / 4000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.7) < 0.002 and abs(share["test"] - 0.15) < 0.002
    assert splits.assign_splits(df.limit(0), {"train": 1.0}).count() == 0
    with pytest.raises(ValueError):
        splits.assign_splits(df, {"train": 0.0})


def test_one_rule_for_every_size_of_unit(spark, monkeypatch):
    rnd = random.Random(8)
    sizes = {f"g{i}": rnd.choice([1, 2, 3, 5, 60, 400]) for i in range(300)}
    df = spark.createDataFrame([(u, float(n)) for u, n in sizes.items()] + [(None, 3.0), (None, 4.0), ("g0", None)], "component string, n double")
    shares = {"train": 70, "validation": 15, "test": 15}
    out = splits.assign_splits(df, shares, weight="n").collect()
    held = {}
    for r in out:
        held[r.split] = held.get(r.split, 0) + (r.n or 0)
    total = sum(held.values())
    assert len(out) == 303 and all(abs(held[s] / total - x / 100) < 0.01 for s, x in shares.items())
    monkeypatch.setattr(splits, "ALONE", 40)  # batches after the 40th unit
    batched = splits.assign_splits(df, shares, weight="n").collect()
    share = {s: sum(r.n or 0 for r in batched if r.split == s) / total for s in shares}
    assert len(batched) == 303 and all(abs(share[s] - x / 100) < 0.02 for s, x in shares.items())
    heavy = sorted(sizes, key=lambda u: (-sizes[u], u))[:40]
    assert {(r.component, r.split) for r in batched if r.component in heavy} <= {(r.component, r.split) for r in out}


def test_words():
    assert words("<p>The ﬁne Café don’t  résumé</p> STRASSE straße_x") == ["the", "fine", "cafe", "don", "t", "resume", "strasse", "strasse", "x"]
    assert words("") == [] and words("a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=20))) for i in range(12)] + [(50, None), (None, "a b"), (51, ""), (52, "too short")]
    docs = []
    for d in range(150):
        t = rnd.choices(vocab, k=30)
        if rnd.random() < 0.5:
            w = items[rnd.randrange(12)][1].split()
            n, s = rnd.randint(8, 20), rnd.randint(0, 20)
            t[s:s] = [x.upper() for x in w[:n]]
        docs.append((d, ", ".join(t)))
    for d in range(150, 200):  # passages with a word put in, left out or moved
        w = items[rnd.randrange(12)][1].split()
        k = rnd.randrange(5, 15)
        w[k:k] = rnd.choices(vocab, k=rnd.randrange(0, 4))
        del w[rnd.randrange(len(w))]
        docs.append((d, " ".join(rnd.choices(vocab, k=10) + w + rnd.choices(vocab, k=10))))
    docs += docs[:60] and [(1000 + i, docs[0][1]) for i in range(80)] + [(2000, None), (2001, ""), (2002, "x " * 50_000 + items[0][1])]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    d = d.unionByName(d.where("doc_id = 3"))
    want = {(a, b): n for a, x in docs if x and a < 2002 for b, y in items if b is not None and y and (n := leaks.brute_force(x, y, 12, 2))[1]}
    want[2002, 0] = (20, 20)
    assert {n[0] >= 12 for n in want.values()} == {True, False}
    for words in (leaks.ITEM_WORDS, 50):  # all items at once, and in blocks
        got = leaks.leaked(d, i, "doc_id", "item_id", "text", item_words=words)
        assert {(r.doc, r.item): (r.phrase, r.near) for r in got.collect()} == want
    assert leaks.leaked(d.limit(0), i, "doc_id", "item_id", "text").count() == 0
    assert leaks.leaked(d, i.limit(0), "doc_id", "item_id", "text").count() == 0
    assert leaks.leaked(d.withColumn("doc_id", F.lit(None).cast("long")), i, "doc_id", "item_id", "text").count() == 0


def test_texts_of_one_id_are_not_mixed(spark):
    w = [f"w{i}" for i in range(14)]
    docs = spark.createDataFrame([(1, " ".join(w[:8])), (1, " ".join(w[8:])), (2, " ".join(w[:7])), (2, "X. " + " ".join(w))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(w))], "item_id long, text string")
    assert [(r.doc, r.phrase) for r in leaks.leaked(docs, items, "doc_id", "item_id", "text").collect()] == [(2, 14)]


def test_flight_keeps_count_and_size():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1000, 500).astype(float)
    p = np.full(500, 0.37)
    q = mixing.flight(x, p, np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())
    assert set(np.unique(mixing.landing(x, q, np.random.default_rng(2)))) <= {0.0, 1.0}


def test_cube_in_several_groups(spark):
    units = spark.range(3000).select(F.lit("s").alias("source"), F.col("id").alias("doc"), (F.col("id") % 97 + 1).alias("tokens"), F.lit(0.3).alias("p"))
    out = mixing.cube_sample(units, group=400).agg(F.count("*"), F.sum("p"), F.sum(F.col("p") * F.col("tokens"))).first()
    exact = units.agg(F.sum("p"), F.sum(F.col("p") * F.col("tokens"))).first()
    assert out[0] == 3000 and abs(out[1] - exact[0]) <= 2 and abs(out[2] - exact[1]) <= 200


def test_true_sources_equal_brute_force(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, old = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
        return row[-1]

    rnd = random.Random(5)
    goal = ["".join(rnd.choices("abc", k=rnd.randint(1, 7))) for _ in range(40)] + ["long_name-x"]
    filed = [*goal, "", "a", None, "LONG NAMEX", "z" * 5000, *["".join(rnd.choices("abcd", k=rnd.randint(1, 8))) for _ in range(200)]]
    got = mixing.true_sources(spark.createDataFrame([(f, 1) for f in filed], "filed string, tokens long"), spark.createDataFrame([(g,) for g in goal], "source string"))
    bare = lambda x: "".join(c for c in x.lower() if c.isalnum())
    want = {}
    for f in filed:
        near = min(((edits(bare(f), bare(g)), g) for g in goal), default=(9, "")) if f is not None and len(f) < 100 else (9, "")
        if near[0] <= 2:
            want[f] = near[1]
    assert {r.filed: r.source for r in got.collect()} == want


def test_groups_are_sized_by_counts():
    index = neighbours.MultiIndex(np.random.default_rng(3).normal(size=(400, 4)), 10)
    counts = np.random.default_rng(4).integers(0, 3 * neighbours.PER_GROUP // 4, index.sizes[0] * index.sizes[1])
    group = index.grouping(counts)
    held = np.bincount(group, counts)
    assert (np.diff(group) >= 0).all() and set(group) == set(range(len(held))) and held.max() <= 2 * neighbours.PER_GROUP


def test_walk_stops_at_the_radius():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    index = neighbours.MultiIndex(x, 12)
    d = index.halves(x)
    q, c = index.within(d, 0.9)
    visited, cell = set(zip(q.tolist(), c.tolist())), index.cells(d)
    for i in range(500):
        near = np.flatnonzero(((x - x[i]).astype(float) ** 2).sum(1) <= 0.81)
        assert all((i, cell[j]) in visited for j in near)
    assert len(visited) < 500 * index.sizes[0] * index.sizes[1] / 2


@pytest.mark.skipif(not os.path.exists(TOKENS), reason="no tokenizer")
def test_both_kinds_of_tokenizer_count_alike():
    texts = ["", "Hello there, it's 12:30!", "Grüße  an\t\tdie\n\nWelt <|endoftext|> ", "x" * 5000, " " * 3_000_000, "a" + " " * 2_500_000 + "b", "été 東京 \U0001f600 'll"]
    counts = [mixing.counter(f, open(f, encoding="utf-8").read())(texts) for f in (TOKENS, TOKENS.replace(".tiktoken", ".json"))]
    assert counts[0] == counts[1] and counts[0][0] == 0


@pytest.mark.skipif(not os.path.exists(TOKENS), reason="no tokenizer")
def test_mixture(spark):
    docs = [(i, "some words here " * (i % 7 + 1), "Source-A" if i % 3 else "source_b") for i in range(400)] + [(900, None, "source_a"), (901, "", "source_a"), (None, "x", "source_a"), (902, "text", None), (903, "text", "other")]
    d = spark.createDataFrame(docs + docs[:20], "doc_id long, text string, source string").withColumn("tokens", F.lit(1)).withColumn("p", F.lit(1))
    t = spark.createDataFrame([("source_a", 0.4, 1), ("source_b", 0.6, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(d, t, "doc_id", "text", "source", TOKENS)
    by = {r.source: r for r in mixing.shares(mix, t).collect()}
    assert abs(by["source_a"].actual_share - 0.4) < 0.01 and by["source_b"].most_copies <= 3 and by["source_a"].most_copies == 1
    assert mix.count() == mix.select("doc").distinct().count()
    assert mixing.mixture(d.limit(0), t, "doc_id", "text", "source", TOKENS).count() == 0


def test_areas_on_held_out_documents(spark):
    rnd = random.Random(6)
    vocab = {a: [f"{a}{c}{i}word" for i in range(12) for c in "xyz"] for a in ("law", "sport", "code")}
    docs, labels, truth = [], [], set()
    for d in range(260):
        picked = rnd.sample(sorted(vocab), rnd.choice([1, 1, 2]))
        s = [" ".join(rnd.choices(vocab[a], k=7) + ["the", "of"]) for a in picked for _ in range(rnd.randint(3, 5))] + ["nothing of note was said today"] * 2
        s.append("aside the word " + rnd.choice(vocab[rnd.choice(sorted(vocab))]) + " came up once")
        rnd.shuffle(s)
        docs.append((d, ". ".join(s) + "."))
        truth |= {(d, a) for a in picked}
        if d < 160:
            labels += [(d, a.upper() if d % 9 == 0 else a, "r") for a in picked] * (2 if d % 11 == 0 else 1)
    labels += [(3, None, "r"), (4, "unknown", "r"), (None, "law", "r")]
    docs += [(1000, None), (1001, ""), (1002, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("area", F.lit("clash"))
    y = spark.createDataFrame(labels, "doc_id long, area string, reader string")
    a = spark.createDataFrame([("law", ""), ("sport", ""), ("code", "")], "area string, description string")
    got = {(r.doc, r.area) for r in areas.document_areas(d, y, a, "doc_id", "text").collect()}
    held = {x for x in truth if x[0] >= 160}
    ours = {x for x in got if 160 <= x[0] < 260}
    assert len(ours & held) / len(held) >= 0.9 and len(ours & held) / len(ours) >= 0.9
    assert {x[1] for x in got if x[0] == 1002} == {x[1] for x in got if x[0] == 0}
    assert not {x for x in got if x[0] in (1000, 1001)}


def test_whole_words_and_no_dropped_areas(spark, monkeypatch):
    import zlib

    assert zlib.crc32(b"xyz") % areas.BUCKETS in areas.pieces("a" * 64 + "xyz")
    monkeypatch.setattr(areas, "MOST_AREAS", 2)
    d, y = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "law")], "doc_id long, area string")
    with pytest.raises(ValueError):
        areas.document_areas(d, y, spark.createDataFrame([("law",), ("sport",), ("code",)], "area string"), "doc_id", "text")
