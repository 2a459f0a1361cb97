import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fernwake.functions.layout import Layout, split_name
from fernwake.operators import accounting, contrastive, evaluation, folds, models, ordering, preparation, retrieval, schema_drift, sequences, significance, spikes, study, training
from fernwake.operators.schema_match import Column, canonical, changes, exact_pairs, flood, group_of, same_column
from fernwake.sources import recordings
from fernwake.sources.recordings import ScanConfig, discover, read_recordings, recording_of, subject_of

COLS = "file_name string, rig string, written_at timestamp, received_at timestamp, col_pos int, field_id int, col_name string, col_type string"


def test_layout():
    assert split_name("FP1-F7DeltaPower") == ("FP1-F7", "DeltaPower")
    assert split_name("--0") == ("--0", "Value")
    l = Layout(["AMean", "AStd", "BMean", "BStd"])
    assert l.regular and l.channel_groups() == [[0, 1], [2, 3]] and l.band_groups() == []


def test_scan(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"windowStartSec": [0.0], "windowEndSec": [2.0], "label": [1], "A.Mean": [1.0], "AStd": [2.0]}).to_parquet(tmp_path / "chb01_01_features.parquet")
    pd.DataFrame({"windowStartSec": [0.0], "windowEndSec": [2.0], "label": [0], "A.Mean": [3]}).to_parquet(tmp_path / "chb21_01_features.parquet")
    (tmp_path / "notes.parquet").write_text("no subject, never read")
    cfg = ScanConfig(str(tmp_path), aliases={"chb21": "chb01"})
    assert len(discover(spark, cfg)) == 2
    with pytest.raises(ValueError):
        read_recordings(spark, cfg)
    impute = ScanConfig(str(tmp_path), aliases={"chb21": "chb01"}, missing="impute")
    cache = str(tmp_path / "cache")
    df, names = recordings.cached_recordings(spark, impute, cache)
    again, kept = recordings.cached_recordings(spark, impute, cache)
    rows = again.orderBy("row_idx").collect()
    assert names == kept == ["A.Mean", "AStd"] and sorted(map(str, df.collect())) == sorted(map(str, rows))
    assert [r.subject for r in rows] == ["chb01", "chb01"] and rows[1].features == [3.0, None] and [r.row_idx for r in rows] == [0, 1]
    pd.DataFrame({"windowStartSec": [0.0], "windowEndSec": [2.0], "label": [0], "A.Mean": [5.0], "AStd": [1.0]}).to_parquet(tmp_path / "chb02_01_features.parquet")
    assert recordings.cached_recordings(spark, impute, cache)[0].count() == 3  # another signature
    assert recordings.of_subjects(again, ["chb02"]).count() == 0
    only, _ = read_recordings(spark, ScanConfig(str(tmp_path), subjects=("chb02",)))
    assert [r.subject for r in only.collect()] == ["chb02"]
    with pytest.raises(ValueError):
        read_recordings(spark, ScanConfig(str(tmp_path), columns=("Other",), missing="impute"))
    with pytest.raises(FileNotFoundError):
        discover(spark, ScanConfig(str(tmp_path / "none")))
    with pytest.raises(ValueError):
        subject_of("x.parquet", r"(chb\d+)")
    assert recording_of("chb01_01_features.parquet") == "chb01_01"


def test_row_places_in_split_files(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") % 3).alias("r"), F.col("id").cast("double").alias("windowStartSec"), F.lit(2.0).alias("windowEndSec"), F.lit(0).alias("label"), F.rand(1).alias("AMean")).withColumn("file", F.concat(F.lit("chb0"), F.col("r") + 1, F.lit("_01_features"))).drop("r")
    recordings.write_recordings(df, str(tmp_path), "file", ["windowStartSec"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got, _ = read_recordings(spark, ScanConfig(str(tmp_path)))
        assert got.where("row_idx <> (window_start - window_start % 3) / 3 + (window_start % 3) * 10000").count() == 0 and got.count() == 30_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_tables_and_objects_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "id int, name string, v double")
    for kind in ("csv", "json", "parquet"):
        recordings.write_table(df, f"{tmp_path}/t.{kind}")
    both = recordings.read_tables(spark, [f"{tmp_path}/t.{k}" for k in ("csv", "json", "parquet")])
    assert both.count() == 6 and both.where("name = 'a,b' and v = 1.5").count() == 3
    with pytest.raises(ValueError):
        recordings.write_table(df, f"{tmp_path}/t.txt")
    recordings.save_json({"a": np.float32(1.5), "b": np.arange(3)}, f"{tmp_path}/x/o.json")
    assert recordings.load_json(f"{tmp_path}/x/o.json") == {"a": 1.5, "b": [0, 1, 2]}
    recordings.archive(df.withColumn("seed", F.lit(3)), f"{tmp_path}/archive", ["id", "seed"])
    assert recordings.read_archive(spark, f"{tmp_path}/archive", id=1, seed=3).count() == 1 and recordings.read_archive(spark, f"{tmp_path}/archive", id=7).count() == 0
    stats = recordings.flatten_stats(spark.createDataFrame([("f", {"cosine@5": 1.0, "odd": 2.0})], "fold string, s map<string,double>"), "s")
    assert {(r.metric, r.k, r.value) for r in stats.collect()} == {("cosine", 5, 1.0), ("odd", None, 2.0)}


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "BANK_BLOCK", 6)
    rng = np.random.default_rng(0)
    b, q = rng.normal(size=(31, 8)).astype("float32"), rng.normal(size=(7, 8)).astype("float32")
    frame = lambda m, at: spark.createDataFrame([(at + i, v.tolist(), i % 2, "g") for i, v in enumerate(m)], "id long, vec array<float>, label int, group string")
    for metric, score in (("dot", -(q.astype(float) @ b.T)), ("euclidean", np.linalg.norm(q[:, None].astype(float) - b[None], axis=2))):
        got = retrieval.top_k(frame(q, 1000), frame(b, 0), 10, metric, 8, strategy="blocked").collect()
        assert sorted(map(str, got)) == sorted(map(str, retrieval.top_k(frame(q, 1000), frame(b, 0), 10, metric, 8, strategy="broadcast").select(list(got[0].asDict())).collect()))
        for i in range(7):
            assert [r.neighbour_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1000 + i] == np.argsort(score[i], kind="stable")[:10].tolist()
    assert retrieval.top_k(frame(q[:0], 0), frame(b, 0), 3, "dot", 8).count() == 0
    assert retrieval.top_k(frame(q, 0), frame(b[:0], 0), 3, "dot", 8).count() == 0
    with pytest.raises(ValueError):
        retrieval.top_k(frame(q, 0), frame(b, 0), 3, "other", 8)
    monkeypatch.setattr(retrieval, "MOST_BANK", 100)
    with pytest.raises(ValueError):
        retrieval.top_k(frame(q, 0), frame(b, 0), 3, "dot", 8, strategy="broadcast").count()
    assert retrieval.top_k(frame(q, 1000), frame(b, 0), 3, "dot", 8).count() == 21


def test_a_query_never_meets_itself(spark):
    rows = spark.createDataFrame([(10, [0.0, 2.0], 1, "a"), (11, [0.0, 4.0], 0, "a"), (12, [0.0, 8.0], 1, "b"), (13, [1.0, 0.0], 0, "b"), (14, None, 1, "b"), (None, [1.0, 1.0], 1, "b")], "id long, vec array<float>, label int, group string")
    near = retrieval.top_k(rows, rows, 2, "cosine", 2).collect()
    assert {r.query_id: {x.neighbour_id for x in near if x.query_id == r.query_id} for r in near} == {10: {11, 12}, 11: {10, 12}, 12: {10, 11}, 13: {10, 11}}
    got = {r.query_id: r.score for r in retrieval.vote(retrieval.top_k(rows, rows, 2, "cosine", 2), "cosine", weighted=False).collect()}
    assert got == {10: 0.5, 11: 1.0, 12: 0.5, 13: 0.5}
    assert {r.query_id: r.score for r in retrieval.vote(retrieval.top_k(rows, rows, 2, "cosine", 2), "cosine").collect()}[13] == 0.0  # all weights are 0


def test_folds_search_apart(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{i % 2}", i, [float(v) for v in rng.normal(size=3)], i % 2, "g") for i in range(40)] + [(f"f{(i + 1) % 2}", i, [float(v) for v in rng.normal(size=3)], 0, "g") for i in range(6)]
    df = spark.createDataFrame(rows, "fold string, id long, vec array<float>, label int, group string")
    with pytest.raises(ValueError):
        retrieval.top_k(df, df, 3, "dot", 3, strategy="other")
    for metric, strategy in (("euclidean", "blocked"), ("euclidean", "broadcast"), ("entangled", "auto")):
        got = retrieval.top_k(df, df, 3, metric, 3, fold="fold", strategy=strategy)
        want = None
        for f in ("f0", "f1"):
            own = df.where(F.col("fold") == f)
            part = retrieval.top_k(own, own, 3, metric, 3).withColumn("fold", F.lit(f)).select(got.columns)
            want = part if want is None else want.unionByName(part)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_by_hash(spark):
    import hashlib

    df = spark.range(3000).select("id", (F.col("id") % 3 > 0).cast("int").alias("label"))
    got = {(r.label, r.id) for r in retrieval.first_by_hash(df, 150, "s", ["label"]).collect()}
    key = lambda i: (hashlib.md5(f"{i}s".encode()).hexdigest(), i)
    assert got == {(k, i) for k in (0, 1) for i in sorted((i for i in range(3000) if int(i % 3 > 0) == k), key=key)[:150]}
    assert retrieval.first_by_hash(df, 5000, "s", ["label"]).count() == 3000 and retrieval.first_by_hash(df.limit(0), 5, "s", ["label"]).count() == 0


def test_banks_are_capped_and_guarded(spark):
    df = spark.range(60).select("id", F.array(F.lit(1.0)).cast("array<float>").alias("vec"), (F.col("id") % 6 == 0).cast("int").alias("label"), (F.col("id") % 4).cast("string").alias("group"))
    banks = retrieval.build_banks(df, 12, "1")
    for r in banks.groupBy("fold").agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg"), F.count(F.when(F.col("group") == F.col("fold"), 1)).alias("own")).collect():
        assert r.pos == sum(1 for i in range(60) if i % 6 == 0 and str(i % 4) != r.fold) and r.neg == 12 and r.own == 0
    retrieval.guard(banks, df)
    with pytest.raises(ValueError):
        retrieval.guard(banks.unionByName(df.where("id = 5").withColumn("fold", F.lit("1"))), df)
    with pytest.raises(ValueError):
        retrieval.guard(banks.withColumn("id", F.col("id") + 100), df)
    assert retrieval.build_banks(df, None, "1").count() == 180


def test_second_kernel_equals_gates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 3))
    h = np.array([[1, 1], [1, -1]]) / np.sqrt(2)

    def state(a):
        s = np.zeros(8, complex)
        s[0] = 1
        for _ in range(2):
            s = np.kron(np.kron(h, h), h) @ s
            for i in range(3):
                s = s * np.array([np.exp(2j * a[i]) if b >> (2 - i) & 1 else 1 for b in range(8)])
            for i in range(3):
                for j in range(i + 1, 3):
                    flip = np.array([b ^ ((b >> (2 - i) & 1) << (2 - j)) for b in range(8)])
                    s = s[flip]
                    s = s * np.array([np.exp(2j * (np.pi - a[i]) * (np.pi - a[j])) if b >> (2 - j) & 1 else 1 for b in range(8)])
                    s = s[flip]
        return s

    assert np.allclose(retrieval.entangled_states(x, 2), [state(a) for a in x])
    assert retrieval.kernel_of(False) == "rbf" and retrieval.kernel_of(True) == "fidelity" and retrieval.kernel_of(True, "entangled") == "entangled" and retrieval.kernel_of(True, "none") == "rbf"
    with pytest.raises(ValueError):
        retrieval.kernel_of(True, "other")


def test_guard(spark):
    bank = spark.createDataFrame([(0, "a"), (9, "b")], "id long, group string")
    train = spark.createDataFrame([(i,) for i in range(5)], "id long")
    with pytest.raises(ValueError):
        folds.assert_no_leakage(bank, "b", train)
    folds.assert_no_leakage(bank.where("id < 5"), "b", train)


def test_every_fold_is_guarded(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 5.0), (3, "c", 9.0)], "id long, group string, v double")
    bank = spark.createDataFrame([("a", 2, "b"), ("a", 0, "a"), ("b", 0, "a"), ("b", 7, "c")], "test_group string, id long, group string")
    got = {r.test_group: (r.of_test_group, r.not_in_training) for r in folds.fold_leakage(bank, rows, folds.make_folds(rows)).collect()}
    assert got == {"a": (1, 1), "b": (0, 1), "c": (0, 0)}


def _plain_fit(x, y, s):
    """One fold's fit with NumPy on its training rows."""
    good = np.where(np.isfinite(x), x, np.nan)
    med = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in good.T])
    z = np.where(np.isfinite(x), x, med)
    center, scale = (z.mean(0), z.std(0)) if s.scaler == "standard" else (np.quantile(z, 0.5, axis=0), np.quantile(z, 0.75, axis=0) - np.quantile(z, 0.25, axis=0)) if s.scaler == "robust" else (0 * med, 0 * med + 1)
    scale = np.where(scale <= 1e-12, 1.0, scale)
    between = sum((y == k).sum() * (z[y == k].mean(0) - z.mean(0)) ** 2 for k in np.unique(y)) / (len(np.unique(y)) - 1)
    within = sum(((z[y == k] - z[y == k].mean(0)) ** 2).sum(0) for k in np.unique(y)) / (len(y) - len(np.unique(y)))
    with np.errstate(divide="ignore", invalid="ignore"):
        f = between / within
    kept = np.sort(np.lexsort((np.arange(len(f)), -np.where(np.isnan(f) | (within < 1e-20), -np.inf, f)))[: s.select]) if s.select else np.arange(len(f))
    out = lambda a: ((np.where(np.isfinite(a), a, med) - center) / scale)[:, kept]
    if s.components is None:
        return med, kept, out
    own = out(x)
    w, v = np.linalg.eigh(np.cov(own.T))
    v = v[:, ::-1].T
    n = s.components if s.components >= 1 else int(np.searchsorted(np.cumsum(w[::-1]) / w.sum(), s.components)) + 1
    v = v[:n] * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:n, None]
    return med, kept, lambda a: (out(a) - own.mean(0)) @ v.T


@pytest.mark.parametrize("settings", [("standard", None, None), ("robust", None, None), ("none", None, None), ("standard", 3, None), ("robust", 4, 2), ("standard", None, 0.8)])
def test_fold_preparation_equals_numpy(spark, settings):
    rng = np.random.default_rng(11)
    x = rng.normal([0, 5, -300, 1e4, 7, 0], [1, 2, 50, 1, 0, 1], size=(90, 6))
    x[:, 5] = np.nan
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, 4], x[3, 0], x[4, 1] = 7.0, np.inf, -np.inf
    x[:, 0] += np.repeat([0, 1, 2], 30)
    x[5:25, 1] = x[5, 1]  # ties
    y, g = (np.arange(90) % 3 == 0).astype(int), np.array(["a", "b", "c"])[np.arange(90) % 7 % 3]
    rows = [(i, str(a), int(b), [float(v) for v in r]) for i, (a, b, r) in enumerate(zip(g, y, x))]
    df = spark.createDataFrame(rows + [(900, None, 1, [0.0] * 6), (901, "a", 1, None), (902, "a", 1, [1.0])], "id long, group string, label int, x array<double>").withColumn("test_group", F.lit("clash"))
    s = preparation.Settings(*settings)
    fits = preparation.fit_folds(df, 6, s)
    out = preparation.apply_folds(df, fits).collect()
    assert len(out) == 270 and {(r.test_group, r.id) for r in out if r.role == "test"} == {(a, i) for i, a in enumerate(g)}
    for i, fold in enumerate("abc"):
        med, kept, plain = _plain_fit(x[g != fold], y[g != fold], s)
        assert np.allclose(fits.median[i], med) and fits.selected[i].tolist() == kept.tolist()
        got = np.array([r.x for r in sorted((r for r in out if r.test_group == fold), key=lambda r: r.id)])
        assert np.allclose(got, plain(x), rtol=1e-4, atol=1e-4)
    assert preparation.prepare_folds(df.limit(0), 6, s).count() == 0
    assert {r.test_group for r in preparation.apply_folds(df, fits, ["b"]).collect()} == {"b"}


def test_rows_of_both_sides_are_refused(spark):
    a = spark.range(5)
    preparation.assert_disjoint(a, a.where("id > 9"))
    with pytest.raises(ValueError):
        preparation.assert_disjoint(a, a.where("id = 4"))
    with pytest.raises(ValueError):
        preparation.Settings("other")


def test_metrics_edges(spark):
    one = spark.createDataFrame([(1, 0.2), (1, 0.9), (None, 0.1), (1, None)], "y int, score double")
    assert evaluation.average_precision(one, []).first()[0] is None and evaluation.roc_auc(one, []).first()[0] is None
    assert evaluation.tune_threshold(one, "f1", []).first()["threshold"] == 0.5
    two = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.9)], "y int, score double")
    assert evaluation.average_precision(two, []).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert evaluation.roc_auc(two, []).first()[0] == pytest.approx(0.875)
    assert evaluation.mean_std(two.limit(1), [], "score").first()["std"] == 0.0


def test_distributions():
    assert significance.studentized_sf(3.314, 3) == pytest.approx(0.05, abs=2e-4) and significance.studentized_sf(3.633, 4) == pytest.approx(0.05, abs=2e-4)
    assert significance.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4) and significance.chi2_sf(0, 3) == 1.0
    assert significance.studentized_isf(0.05, 3) == pytest.approx(3.314, abs=2e-3)
    mean, lo, hi = significance.bootstrap_interval([1.0, 2.0, 3.0], None, 500)
    assert lo <= mean <= hi


def test_losses():
    far = np.eye(3)[[0, 0, 1, 1, 2, 2]].reshape(3, 2, 3)  # three rows of two equal views
    want = math.log(math.e**10 + 4) - 10  # one positive at 1, four others at 0, temperature 0.1
    assert contrastive.batch_loss(far, np.array([4, 5, 6]), "supcon") == pytest.approx(want) == contrastive.batch_loss(far, np.zeros(3), "simclr")
    assert contrastive.batch_loss(far[:, :1], np.array([0, 1, 2]), "supcon") == 0.0  # no anchor has a positive
    with pytest.raises(ValueError):
        contrastive.batch_loss(far, np.zeros(3), "other")
    x = np.random.default_rng(1).normal(size=(5, 2, 6))
    x /= np.linalg.norm(x, axis=2, keepdims=True)
    y = np.array([0, 0, 1, 0, 1])
    for name in contrastive.LOSSES:
        value, g = contrastive.loss_and_gradient(x, y, name)
        assert np.isfinite(value) and np.isfinite(g).all()
        if name != "focal":  # whose weights are constants of the gradient
            step = np.zeros_like(x)
            step[2, 1, 3] = 1e-6
            assert g[2, 1, 3] == pytest.approx((contrastive.batch_loss(x + step, y, name) - contrastive.batch_loss(x - step, y, name)) / 2e-6, abs=1e-4)


def test_budgets(spark):
    names = accounting.MEASURED
    rows = [(0.1, 20.0, 2.0, 3.0, 1.0, 10.0, 500.0), (0.1, 20.0, 2.0, 3.0, 1.0, 10.0, 5000.0), (0.1, 5000.0, 2.0, 3.0, 1.0, 10.0, 500.0), (float("nan"), 20.0, 2.0, 3.0, 1.0, 10.0, 500.0), (0.1, None, 2.0, 3.0, 1.0, 10.0, 500.0), (0.1, 0.0, 2.0, 3.0, 1.0, 10.0, 500.0)]
    got = accounting.plan_budget(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), max_hours=5.0, reserve_hours=0.5, safety=1.5, least_steps=10).collect()
    # 4.5 h / 1.5 = 10,800 s; six runs of 35 s leave 10,590 s for 60 epochs of 0.1 s a step
    assert [(r.refusal, r.steps_per_epoch) for r in got] == [(None, 500), (None, 1765), ("too little time", None), ("incomplete", None), ("incomplete", None), ("incomplete", None)]
    assert got[0].runs == 6 and got[0].training_hours == pytest.approx(3000 / 3600) and got[0].overhead_hours == pytest.approx(210 / 3600) and got[0].estimated_hours_with_margin == pytest.approx(1.5 * 3210 / 3600)
    with pytest.raises(ValueError):
        accounting.plan_budget(spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), max_hours=1.0, reserve_hours=1.0)


def test_stages_are_measured(spark):
    t = accounting.Tracker()
    with t.stage("fit", "a", "f1", 3):
        pass
    with pytest.raises(KeyError), t.stage("broken"):
        raise KeyError
    got = t.table(spark).collect()
    assert [(r.stage, r.fold, r.seed) for r in got] == [("fit", "f1", 3), ("broken", "", 0)] and all(r.seconds >= 0 and r.peak_mb > 0 for r in got)
    assert accounting.git_revision("none", "/") == "none"


def test_views(spark):
    layout = Layout([f"{c}{t}" for c in ("A", "B", "C", "D", "E") for t in ("Mean", "AlphaPower", "BetaPower")])
    always = dict(noise_chance=0.0, scale_chance=0.0, channels_chance=0.0, bands_chance=0.0, span_chance=0.0)
    rows = spark.range(400).select("id", F.array(*[F.lit(1.0)] * 30).alias("vec"))
    run = lambda **k: np.array([r.vec for r in contrastive.augmented(rows, layout, contrastive.Views(**{**always, **k}), steps=2).orderBy("id", "view").collect()]).reshape(800, 2, 5, 3)
    assert (run() == 1).all()
    c = run(channels_chance=1.0, channels=3)
    gone = (c == 0).all((1, 3)).sum(1)  # whole channels, the same in all steps
    assert set(gone) == {1, 2, 3} and ((c == 0).sum((1, 2, 3)) == gone * 6).all()
    b = run(bands_chance=0.5)
    hit = (b == 0).all((1, 2)).sum(1)
    assert set(hit) == {0, 1} and 0.4 < hit.mean() < 0.6 and (b[..., 0] == 1).all()
    t = run(span_chance=1.0, span=0.5)
    assert ((t == 0).all((2, 3)).sum(1) == 1).all()
    s = run(scale_chance=0.5, scale=0.2)
    assert 0.4 < (s[:, 0, 0, 0] != 1).mean() < 0.6 and 0.8 <= s.min() and s.max() <= 1.2 and (s.reshape(800, -1).std(1) < 1e-12).all()
    n = run(noise_chance=1.0, noise=0.1) - 1
    assert abs(n.mean()) < 0.005 and abs(n.std() - 0.1) < 0.005
    again = np.array([r.vec for r in contrastive.augmented(rows.repartition(7), layout, contrastive.Views(), seed=5).orderBy("id", "view").collect()])
    assert (again == np.array([r.vec for r in contrastive.augmented(rows, layout, contrastive.Views(), seed=5).orderBy("id", "view").collect()])).all()
    m = contrastive.augment_matrix(np.ones((500, 15)), contrastive.Views(**{**always, "channels_chance": 1.0, "channels": 2}), layout, np.random.default_rng(0)).reshape(500, 5, 3)
    assert set((m == 0).all(2).sum(1)) == {1, 2}
    with pytest.raises(ValueError):
        contrastive.Views(n=1)


def test_balanced_batches(spark):
    rows = spark.range(300).select("id", (F.col("id") == 7).cast("int").alias("label")).unionByName(spark.createDataFrame([(None, 1), (900, None)], "id long, label int"))
    got = contrastive.balanced_batch(rows, 1000, 0.5, 3).collect()
    assert sorted(r.draw for r in got) == list(range(1000)) and 0.45 < np.mean([r.label for r in got]) < 0.55
    assert {r.id for r in got if r.label == 1} == {7} and len({r.id for r in got}) > 200
    assert sorted(map(str, got)) == sorted(map(str, contrastive.balanced_batch(rows.repartition(5), 1000, 0.5, 3).collect()))
    with pytest.raises(ValueError):
        contrastive.balanced_batch(rows.where("label = 0"), 5, 0.5, 3)


LAYOUT = Layout([f"{c}{t}" for t in ("Mean", "Std") for c in ("A", "B", "C")])  # types first, so that channels are gathered


def test_encoders_by_hand():
    from fernwake.operators import encoders as en

    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 4, 6))
    s = en.Shape("cnn1d", embedding=8, channels=(5,), heads=2, blocks=1, projection=4, steps=4)
    w = en.new_weights(s, LAYOUT, 2)
    w["norm0.mean"], w["norm0.var"], w["norm0.gain"], w["norm0.shift"] = rng.normal(size=5), rng.uniform(0.5, 2, 5), rng.normal(size=5), rng.normal(size=5)

    def cnn(row):
        grid = np.array([[row[0], row[1], row[2]], [row[3], row[4], row[5]]])  # types x channels
        h = np.zeros((5, 3))
        for o in range(5):
            for at in range(3):
                z = w["conv0.b"][o] + sum(w["conv0.w"][o, t, k] * grid[t, at + k - 1] for t in range(2) for k in range(3) if 0 <= at + k - 1 < 3)
                h[o, at] = max(0, (z - w["norm0.mean"][o]) / np.sqrt(w["norm0.var"][o] + 1e-5) * w["norm0.gain"][o] + w["norm0.shift"][o])
        return h.mean(1) @ w["out.w"] + w["out.b"]

    assert np.allclose(en.encode(x[:, 0], w, s, LAYOUT), [cnn(r) for r in x[:, 0]]) and np.allclose(en.encode(x, w, s, LAYOUT), [np.mean([cnn(r) for r in q], 0) for q in x])
    odd = Layout(["AMean", "AStd", "BMean"])
    assert not odd.regular and en.encode(x[:, 0, :3], en.new_weights(s, odd, 1), s, odd).shape == (3, 8)

    s = en.Shape("tcn", embedding=3, channels=(4, 4), steps=4)
    w = en.new_weights(s, LAYOUT, 3)

    def causal(h, at, dilation):
        k = w[f"{at}.w"]
        return np.array([w[f"{at}.b"] + sum(k[:, :, j] @ h[t - (k.shape[2] - 1 - j) * dilation] for j in range(k.shape[2]) if t - (k.shape[2] - 1 - j) * dilation >= 0) for t in range(len(h))])

    def tcn(h):
        for i in range(2):
            y = np.maximum(causal(np.maximum(causal(h, f"block{i}.first", 2**i), 0), f"block{i}.second", 2**i), 0)
            h = np.maximum(y + (causal(h, f"block{i}.skip", 1) if i == 0 else h), 0)
        return h.mean(0) @ w["out.w"] + w["out.b"]

    assert np.allclose(en.encode(x, w, s, LAYOUT), [tcn(q) for q in x])

    s = en.Shape("cnn1d_transformer", embedding=4, channels=(3,), heads=2, blocks=1, steps=2)
    w = en.new_weights(s, LAYOUT, 5)
    w["token"] = rng.normal(size=(1, 1, 4))
    stem = en.encode(x[:, :2].reshape(-1, 6), w, en.Shape("cnn1d", embedding=4, channels=(3,)), LAYOUT).reshape(3, 2, 4)
    ln = lambda v, at: (v - v.mean()) / np.sqrt(v.var() + 1e-5) * w[f"{at}.gain"] + w[f"{at}.shift"]
    for row in range(3):
        h = np.concatenate([w["token"][0], stem[row]])
        q, k, v = (h @ w[f"layer0.{c}.w"] + w[f"layer0.{c}.b"] for c in "qkv")
        parts = []
        for a in (slice(0, 2), slice(2, 4)):
            e = np.exp(q[0, a] @ k[:, a].T / np.sqrt(2))
            parts.append(e / e.sum() @ v[:, a])
        first = ln(h[0] + np.concatenate(parts) @ w["layer0.o.w"] + w["layer0.o.b"], "layer0.norm0")
        up = np.maximum(first @ w["layer0.up.w"] + w["layer0.up.b"], 0)
        assert np.allclose(en.encode(x[:, :2], w, s, LAYOUT)[row], ln(first + up @ w["layer0.down.w"] + w["layer0.down.b"], "layer0.norm1"))
    p = en.project(x[:, :2], w, s, LAYOUT)
    assert p.shape == (3, 64) and np.allclose(np.linalg.norm(p, axis=1), 1)
    with pytest.raises(ValueError):
        en.Shape("other")


def test_kernel_study(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(v) for v in rng.normal(size=5) * [4, 3, 2, 1, 0.1]], int(i % 4 == 0), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, label int, group string")
    plan = study.KernelPlan(qubits=3, cap=20, queries=15, k=4)
    stats, overlaps = study.kernel_study(df, 5, plan)
    got = {r.fold: r for r in stats.collect()}
    assert set(got) == set("abc") and all(r.n_queries == 15 and r.same_group == 0 and 0 <= r.positive_ratio <= 1 for r in got.values())
    assert {(r.fold, r.pair) for r in overlaps.collect()} == {(f, p) for f in "abc" for p in ("kernel_vs_cosine", "kernel_vs_rbf", "cosine_vs_rbf")}
    with pytest.raises(ValueError):
        study.KernelPlan(qubits=40)


def test_sizes_and_costs():
    from fernwake.operators import encoders as en

    s = en.Shape("mlp", embedding=4, hidden=(5,), projection=2, projection_hidden=3)
    w = en.new_weights(s, LAYOUT, 1)
    assert en.count_parameters(w)[0] == 6 * 5 + 5 + 5 + 5 + 5 * 4 + 4 + 4 * 3 + 3 + 3 * 2 + 2
    assert en.flops(w, s, LAYOUT) == 2 * (6 * 5 + 5 * 4)
    s = en.Shape("cnn1d", embedding=4, channels=(5,), steps=2)
    assert en.flops(en.new_weights(s, LAYOUT, 1), s, LAYOUT) == 2 * (2 * 5 * 3 * 3 * 2 + 5 * 4 * 2)


def test_embeddings_of_unusable_rows(spark):
    from fernwake.operators import encoders as en

    s = en.Shape("mlp", embedding=4, hidden=(5,))
    rows = spark.createDataFrame([(1, [1.0] * 6), (2, [float("nan")] * 6), (3, None), (4, [1.0])], "id long, vec array<float>").withColumn("embedding", F.lit(1))
    got = {r.id: r.embedding for r in en.embed(rows, en.new_weights(s, LAYOUT, 1), s, LAYOUT).collect()}
    assert sorted(got) == [1, 2] and all(np.linalg.norm(v) == pytest.approx(1, abs=1e-5) for v in got.values())
    assert en.embed(rows.limit(0), en.new_weights(s, LAYOUT, 1), s, LAYOUT).count() == 0


def test_gradients_of_training():
    from fernwake.operators import encoders as en

    rng = np.random.default_rng(6)
    s = en.Shape("mlp", embedding=4, hidden=(7, 5), projection=3, projection_hidden=6)
    w = en.new_weights(s, LAYOUT, 2)
    x, y = rng.normal(size=(12, 6)), np.array([0, 1, 0, 1, 1, 0])
    _, g, _ = training.forward_backward(x, y, 2, w, s, "supcon")
    for k, d in g.items():
        at = tuple(rng.integers(0, n) for n in d.shape)
        values = []
        for step in (1e-5, -1e-5):
            moved = {**w, k: w[k].copy()}
            moved[k][at] += step
            values.append(training.forward_backward(x, y, 2, moved, s, "supcon")[0])
        assert d[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-5), k


def test_training_learns_and_goes_on_where_it_stopped(spark, tmp_path):
    from fernwake.operators import encoders as en

    rng = np.random.default_rng(9)
    y = (np.arange(240) % 4 == 0).astype(int)
    x = rng.normal(size=(240, 6)) + 1.5 * y[:, None]
    s = en.Shape("mlp", embedding=4, hidden=(16,), projection=4, projection_hidden=8)
    for optimizer, schedule in (("adamw", "cosine"), ("sgd", "step"), ("adam", "none")):
        t = training.Training(loss="supcon", epochs=6, batch=64, steps=6, rate=0.01, optimizer=optimizer, schedule=schedule)
        w, losses = training.train(x, y, LAYOUT, s, t)
        at = f"{tmp_path}/{optimizer}/c"
        training.train(x, y, LAYOUT, s, t, checkpoint=at, stop_after=3)
        again, same = training.train(x, y, LAYOUT, s, t, checkpoint=at)
        assert losses[-1] < losses[0] and same == losses and all(np.array_equal(w[k], again[k]) for k in w)
        with pytest.raises(ValueError):
            training.train(x + 1, y, LAYOUT, s, t, checkpoint=at)
    df = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))] + [(900, 1, None), (901, None, [0.0] * 6), (902, 1, [float("nan")] * 6)], "id long, label int, vec array<double>")
    assert len(training.train_on(df, LAYOUT, s, training.Training(epochs=2, batch=32))[1]) == 2
    with pytest.raises(ValueError):
        training.train(x, np.zeros(240), LAYOUT, s)
    with pytest.raises(ValueError):
        training.Training(optimizer="other")


def test_windows_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 16)
    rows = [("hot", i, i % 7) for i in range(100)] + [("b", i, i) for i in range(3)] + [("c", 0, 1), (None, 1, 1), ("hot", None, 1)]
    df = spark.createDataFrame(rows, "k string, t int, v int").withColumn("pos", F.lit(1)).withColumn("part_no", F.lit(1))
    for length in (1, 3, 5):
        got = {(r.k, r.t): r.window_label for r in sequences.sequence_windows(df.drop("pos", "part_no"), "k", ["t"], length, F.col("v")).collect()}
        own = {k: [r for r in rows if r[0] == k and r[1] is not None] for k in ("hot", "b", "c")}
        want = {(k, x[i][1]): max(r[2] for r in x[i : i + length]) for k, x in own.items() for i in range(len(x) - length + 1)}
        assert got == want
        values = {(r.k, r.t): r["values"] for r in sequences.gather(df.drop("pos", "part_no"), "k", ["t"], length, "v").collect()}
        assert {a: max(v) for a, v in values.items()} == want
    with pytest.raises(ValueError):
        sequences.sequence_windows(df, "k", ["t"], 0, F.col("v"))


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 5, 2.0), (None, 1, 3.0)], "k string, version int, v double")
    new = spark.createDataFrame([("a", 1, 4.0, "x"), ("b", 4, 5.0, "x"), ("c", None, 6.0, "x")], "k string, version int, v double, note string")
    got = {r.k: (r.v, r.note) for r in sequences.upsert(old, new, ["k"], "version").collect()}
    assert got == {"a": (4.0, "x"), "b": (2.0, None), None: (3.0, None), "c": (6.0, "x")} or got == {"a": (4.0, "x"), "b": (2.0, None), None: (3.0, None)}
    assert {(r.k, r.total) for r in sequences.totals_by(old, "k", "v").collect()} == {("a", 1.0), ("b", 2.0), (None, 3.0)}


def test_search_takes_the_first_best(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 3 == 0), "abcd"[i % 4], [float(i % 3 == 0) * 2 + float(v) for v in rng.normal(size=2)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, y int, group string, x array<double>")
    model, best, ap = models.search("logreg", df, 2, 2, {"c": [1.0, 1.0]})
    assert best == {"c": 1.0} and 0.5 < ap <= 1 and model.score(df).count() == 80
    assert math.isnan(models.search("logreg", df, 2, 2, {"c": [0.5]})[2])
    assert len(list(__import__("itertools").product(*models.GRIDS["svm_rbf"].values()))) == 32
    svm = models.Classifier("svm_rbf", 2, c=1.0, balanced=False).fit(df)
    assert svm.params["gamma"] == pytest.approx(1 / (2 * np.var([r[3] for r in rows]))) and svm.score(df).where("score is null").count() == 0


def test_scratch_is_swept(spark, tmp_path):
    from fernwake import session

    s = session.Scratch(spark, "swept")
    kept = s.keep(spark.range(3), "rows")
    assert kept.count() == 3
    session.sweep(spark)
    assert not os.path.exists(s.root.removeprefix("file://")) and not [m for m in session._made if m[0] is spark]


def test_signal_features(spark):
    t = np.arange(0, 6, 1 / 128)
    rows = [("s", float(a), float(3 * np.sin(2 * np.pi * 10 * a) + 5)) for a in t] + [("flat", float(a), 2.0) for a in t[:256]] + [("s", None, 1.0), ("s", 1.0, float("nan")), ("s", 1.0, None)]
    got = sequences.signal_features(spark.createDataFrame(rows, "k string, t double, v double"), "k", "t", "v", 2.0, 1.0, 128.0).collect()
    inside = next(r for r in got if r.k == "s" and r.window_start == 2.0)
    assert inside.n == 256 and inside.mean == pytest.approx(5) and inside.variance == pytest.approx(4.5) and inside.alpha_power == pytest.approx(4.5, rel=0.01) and inside.theta_power < 0.1 and 4 < inside.entropy < 6
    flat = next(r for r in got if r.k == "flat" and r.window_start == 0.0)
    assert flat.entropy == 0 and flat.std == 0 and flat.alpha_power == 0
    assert {r.window_start for r in got if r.k == "s"} == set(map(float, range(-1, 6)))


def test_streams(spark, tmp_path):
    from fernwake.streaming import scoring

    bank = spark.createDataFrame([([1.0, 0.0], 1), ([0.0, 1.0], 0), (None, 1)], "vec array<float>, label int")
    spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.1, 1.0]), (3, None)], "id long, vec array<float>").write.parquet(f"{tmp_path}/in/a.parquet")
    stream = spark.readStream.schema("id long, vec array<float>").parquet(f"{tmp_path}/in/a.parquet")
    run = lambda df, name: df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start(f"{tmp_path}/{name}").awaitTermination()
    run(scoring.score_stream(stream, bank, 1, 2), "scores")
    assert {(r.id, round(r.score, 6)) for r in spark.read.parquet(f"{tmp_path}/scores").collect()} == {(1, 1.0), (2, 0.0)}
    with pytest.raises(ValueError):
        scoring.score_stream(stream, spark.range(10).select(F.array(*[F.lit(1.0)] * 2).alias("vec"), F.lit(1).alias("label")), 1, scoring.MOST_BANK)
    rows = "id long, k string, ts timestamp, v double"
    for i, (ts, v) in enumerate((("2024-01-01 00:00:00", 1.0), ("2024-01-01 00:10:00", 3.0), ("2024-01-01 00:00:01", 99.0))):  # the last one is late
        spark.createDataFrame([(i, "a", __import__("datetime").datetime.fromisoformat(ts), v)], rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        run(scoring.window_stream(spark.readStream.schema(rows).parquet(f"{tmp_path}/events"), "k", "ts", "v"), "windows")
    got = {(str(r.window_start), r.n, r.mean) for r in spark.read.parquet(f"{tmp_path}/windows").collect()}
    assert got == {("2023-12-31 23:59:59", 1, 1.0), ("2024-01-01 00:00:00", 1, 1.0)}


def test_settings(tmp_path):
    from fernwake import settings

    e = settings.load(None, ["study.cap=100", "study.ks=[2,4]", "study.decision_k=4", "training.optimizer=sgd", "scan.folder=/data", "name=first", "name=second"])
    assert e.study.cap == 100 and e.study.ks == (2, 4) and e.training.optimizer == "sgd" and e.scan.folder == "/data" and e.name == "second" and e.encoder == settings.Experiment().encoder
    settings.dump(e, f"{tmp_path}/e.json")
    assert settings.load(f"{tmp_path}/e.json") == e
    (tmp_path / "e.yaml").write_text("training:\n  epochs: 3\n")
    assert settings.load(f"{tmp_path}/e.yaml", ["seed=4"], e).training.epochs == 3
    for bad in ("study.other=1", "study=1", "training.batch=1", "novalue", "name.x=1"):
        with pytest.raises(ValueError):
            settings.load(None, [bad])


def test_rank_tests(spark):
    rng = np.random.default_rng(3)
    rows = [(b, m, float(k + 0.1 * rng.normal())) for b in range(12) for k, m in enumerate("abc")]
    m = significance.matched(spark.createDataFrame(rows, "block int, model string, value double"), "block", "model", "value")
    got = significance.protocol(m).collect()
    assert [r.test for r in got] == ["friedman", "nemenyi", "nemenyi", "nemenyi"] and got[0].statistic == pytest.approx(24) and got[0].p == pytest.approx(math.exp(-12)) and got[0].effect == pytest.approx(1)
    far = next(r for r in got if (r.a, r.b) == ("a", "c"))
    assert far.effect == pytest.approx(2) and far.p < 0.001 and far.high == pytest.approx(3.314 / math.sqrt(2) * math.sqrt(12 / 72), abs=2e-3)
    two = significance.protocol(m.where("model <> 'c'")).collect()
    assert len(two) == 1 and two[0].test == "wilcoxon" and two[0].statistic == pytest.approx(-(78 / 2) / math.sqrt(12 * 13 * 25 / 24)) and two[0].low <= -0.9 and two[0].high >= -1.1
    assert two[0].p == pytest.approx(2 * significance.normal_sf(abs(two[0].statistic)))
    assert significance.protocol(m.where("model = 'a'")).first().note == "1 model" and significance.protocol(m.limit(0)).first().note == "0 model"
    same = spark.createDataFrame([(b, x, 1.0) for b in range(5) for x in "ab"], "block int, model string, value double")
    w = significance.wilcoxon(same, "a", "b").first()
    assert (w.p, w.z, w.effect, w.n) == (1.0, 0.0, 0.0, 0)
    assert significance.friedman(spark.createDataFrame([(b, x, 1.0) for b in range(5) for x in "abc"], "block int, model string, value double")).first().chi2 is None
    p = significance.paired(m, "a", "b", "less", 200).first()
    assert p.mean_a < p.mean_b and p.p < 0.01 and p.low <= p.mean_difference <= p.high
    with pytest.raises(ValueError):
        significance.wilcoxon(m, "a", "b", "other")


def test_panel_and_summary(spark):
    rows = [("k", "a", 1, 0.9), ("k", "a", 0, 0.8), ("k", "a", 1, 0.3), ("k", "a", 0, 0.1), ("k", "b", 0, 0.7), ("k", "b", 0, 0.2)]
    df = spark.createDataFrame(rows, "head string, fold string, y int, score double").withColumn("threshold", F.lit(0.5))
    p = {r.fold: r for r in evaluation.metric_panel(df, ["head", "fold"], 1800.0).collect()}
    a, b = p["a"], p["b"]
    assert (a.n, a.n_pos, a.sensitivity, a.precision_seizure, a.f1_macro, a.specificity, a.fp_per_hour, a.accuracy) == (4, 2, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)
    assert a.auc_pr == pytest.approx(0.5 + 0.5 * 2 / 3) and a.roc_auc == pytest.approx(0.75)
    assert b.auc_pr is None and b.roc_auc is None and b.balanced_accuracy == 0.5 and b.sensitivity == 0
    s = {r.key: r for r in evaluation.summarize(evaluation.metric_panel(df, ["head", "fold"]), ["head"]).withColumn("text", evaluation.as_text(F.col("mean"), F.col("std"), 2)).collect()}
    assert s["specificity"].n == 2 and s["auc_pr"].n == 1 and s["auc_pr"].std == 0 and s["specificity"].text == "0.50 +/- 0.00"
    none = evaluation.summarize(evaluation.metric_panel(df.where("fold = 'b'"), ["head", "fold"]), ["head"]).where("key = 'roc_auc'").select("n", evaluation.as_text(F.col("mean"), F.col("std")).alias("t")).first()
    assert (none.n, none.t) == (0, "n/a")


def test_curves_over_many_ranges(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 700), np.round(rng.random(700), 2)
    df = spark.createDataFrame([("a" if i % 3 else "b", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "g string, y int, score double")
    got = {r.g: r for r in evaluation.curve_areas(df, ["g"]).collect()}
    for g in "ab":
        at = np.array([("a" if i % 3 else "b") == g for i in range(700)])
        yy, ss = y[at], s[at]
        auc = np.mean([(p > n) + (p == n) / 2 for p in ss[yy == 1] for n in ss[yy == 0]])
        ap = sum(((yy == 1) & (ss == t)).sum() / yy.sum() * yy[ss >= t].mean() for t in np.unique(ss))
        assert got[g].roc_auc == pytest.approx(auc) and got[g].average_precision == pytest.approx(ap)


def test_overlap_counts_lacking_queries(spark):
    schema = "query_id long, neighbour_id long"
    a, b = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], schema), spark.createDataFrame([(1, 6), (1, 8), (3, 7)], schema)
    r = retrieval.neighbour_overlap(a, b).first()
    assert r.n_queries == 3 and r.overlap == pytest.approx((1 / 3) / 3)


def test_held_out_scores_every_group(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 3 == 0), "abc"[i % 5 % 3], [float(i % 3 == 0) + float(v) for v in rng.normal(size=2)]) for i in range(60)]
    df = spark.createDataFrame(rows + [(90, 1, None, [0.0, 0.0])], "id long, y int, group string, x array<double>")
    got = {r.id: r.score for r in models.held_out("logreg", df, 2).collect()}
    want = {r.id: r.score for g in "abc" for r in models.Classifier("logreg", 2).fit(df.where(f"group <> '{g}'")).score(df.where(f"group = '{g}'")).collect()}
    assert sorted(got) == list(range(60)) and all(got[i] == pytest.approx(want[i], abs=1e-6) for i in want)
    alone = models.held_out("logreg", df.where("group = 'a' or group = 'b' and y = 0"), 2).collect()
    assert all((r.score is None) == (r.group == "a") for r in alone) and {r.group for r in alone} == {"a", "b"}
    assert models.held_out("logreg", df.limit(0), 2).count() == 0


def test_fidelity_closed_form():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(5, 4)), rng.normal(size=(5, 4))
    k = np.abs(retrieval.phases(x, 2, False) @ retrieval.phases(y, 2, False).conj().T) ** 2
    assert np.allclose(k, np.prod(np.cos(x[:, None] - y[None]) ** 2, axis=2))


def test_schema_changes_edges(spark):
    rows = [
        ("a", "r", "2023-01-01 00:00:00", None, 0, None, "X Mean", "float"), ("a", "r", "2023-01-01 00:00:00", None, 0, None, "X Mean", "float"), ("a", "r", "2023-01-01 00:00:00", None, 1, 5, "old", "float"), ("a", "r", "2023-01-01 00:00:00", None, 2, None, "gone", "long"),
        ("b", "r", "2023-01-02 00:00:00", None, 0, None, "xmean", "double"), ("b", "r", "2023-01-02 00:00:00", None, 1, 5, "new", "float"), ("b", "r", "2023-01-02 00:00:00", None, 2, 9, "more", "long"),
        (None, "r", None, None, 0, None, "x", None), ("c", None, "2023-01-02 00:00:00", None, 0, None, "x", None), ("d", "r", "2023-01-03 00:00:00", None, 0, None, None, None),
    ]
    df = spark.createDataFrame([(*r[:2], None if r[2] is None else __import__("datetime").datetime.fromisoformat(r[2]), *r[3:]) for r in rows], COLS)
    got = {(r.file_name, r.col_name, r.change) for r in schema_drift.schema_changes(df.withColumn("prev", F.lit(1)).withColumn("part_no", F.lit(1))).where("change <> 'similar'").collect()}
    assert got == {("b", "xmean", "renamed"), ("b", "xmean", "retyped"), ("b", "new", "renamed"), ("b", "more", "added"), ("b", "gone", "removed")}
    assert schema_drift.schema_changes(df.limit(0)).count() == 0


def test_flooding_prefers_ids_over_names():
    old = [Column("a1", "f", 1), Column("b1", "f", 2)]
    new = [Column("b1x", "f", 1), Column("a1x", "f", 2)]
    assert {(c, o) for c, k, o, _ in changes(old, new) if k == "renamed"} == {("b1x", "a1"), ("a1x", "b1")}


def _plain_changes(old, new):
    """The exact test alone, over all pairs of lost and gained columns."""
    lost, gained = ([c for c in a if c.name not in {d.name for d in b}] for a, b in ((old, new), (new, old)))
    pairs = [(a, b) for b in gained for a in lost if same_column(a, b)]
    found = {(b.name, "renamed") for _, b in pairs} | {(b.name, "retyped") for a, b in pairs if a.type != b.type}
    found |= {(c.name, "added") for c in gained if c not in [b for _, b in pairs]} | {(c.name, "removed") for c in lost if c not in [a for a, _ in pairs]}
    return found | {(c.name, "retyped") for c in new for d in old if c.name == d.name and c.type != d.type}


def test_no_exact_rename_is_lost_to_a_tie():
    old = [Column("F7-T7Variances", "float", None), Column("F7-T7Variance", "float", None)]
    new = [Column("F7-T7Stx", "float", None), Column("f7_t7variance", "int", None)]
    assert {(c, k) for c, k, *_ in changes(old, new)} >= {("f7_t7variance", "renamed"), ("f7_t7variance", "retyped")}
    rng = random.Random(4)
    names = [f"{c}{t}" for c in ("F7-T7", "FP1-F7", "O1", "T8-P8") for t in ("Mean", "Std", "Variance", "Entropy", "DeltaPower")]
    for _ in range(300):
        ids, old, new = rng.random() < 0.5, [], []
        for i, n in enumerate(rng.sample(names, 12)):
            old.append(Column(n, rng.choice(["float", "int"]), i if ids and rng.random() < 0.7 else None))
        for c in old:
            r = rng.random()
            n = c.name.lower().replace("-", "_") if r < 0.2 else c.name + "s" if r < 0.3 else c.name[:-2] + "x" if r < 0.4 else f"zz{c.field_id}" if r < 0.5 and c.field_id is not None else c.name
            if canonical(n) not in {canonical(x.name) for x in new} and r < 0.95:
                new.append(Column(n, rng.choice([c.type, "double"]), c.field_id))
        assert {(c, k) for c, k, *_ in changes(old, new) if k != "similar"} == _plain_changes(old, new)
        lost, gained = [c for c in old if c.name not in {d.name for d in new}], [c for c in new if c.name not in {d.name for d in old}]
        scores = flood(lost, gained, [group_of(c.name) for c in lost], [group_of(c.name) for c in gained])
        assert not (exact_pairs(lost, gained) & (scores < 1 / 3 - 1e-9)).any()


def test_unified_keeps_text(spark):
    raw = spark.createDataFrame([("f", 0, '{"AMean": "1,5", "note": "left out", "n": "2,50", "label": "7", "a_mean": 9, "m": "NaN"}'), ("f", 0, "{}"), ("f", 1, "no json"), ("f", 2, None), (None, 3, '{"Label": 1}')], "file_name string, row_no long, payload string")
    layout = spark.createDataFrame([(0, "AMean")], "pos int, column_name string")
    got = {r.row_no: r for r in schema_drift.unified(raw, spark.createDataFrame([], COLS), layout).collect()}
    row = got[0]
    assert row.features == [1.5] and [tuple(x) for x in row.extra] == [("m", None, "NaN"), ("n", 2.5, "2,50"), ("note", None, "left out")]
    assert row.label is None and row.n_unread == 2
    assert all(got[i].features == [None] and got[i].extra == [] and got[i].n_unread == 0 for i in (1, 2)) and got[3].label == 1
    assert schema_drift.unified(raw.limit(0), spark.createDataFrame([], COLS), layout.limit(0)).count() == 0


def test_join_on_hot_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id") % 1500).alias("k"), "id")
    right = left.where("k <> 7").groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("id").alias("top"))
    got, want = ordering.join_unique(left, right, "k"), left.join(right.drop("_n"), "k")
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == want.count()
    assert ordering.join_unique(left, right.limit(0), "k").count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([("11,513",), (" 4.69 ",), ("true",), ("x",), (None,), ("nan",), ("1.234,56",), ("1,234.56",), ("1,234,567",), ("1.234.567",), ("-,5",)], "t string")
    assert [r[0] for r in df.select(schema_drift.number(F.col("t"))).collect()] == [11.513, 4.69, 1.0, None, None, None, 1234.56, 1234.56, 1234567.0, 1234567.0, -0.5]


def _brute(rows, tests):
    import itertools

    once = {r[0]: r for r in rows if r[0] is not None and r[2] is not None}
    found = set()
    for src in {r[1] for r in once.values()}:
        if src is None:
            continue
        own = [r for r in once.values() if r[1] == src]
        for p in range(2):
            v = {r[0]: float(np.float32(r[4][p])) for r in own if r[4] is not None and r[4][p] is not None and math.isfinite(r[4][p])}
            if v:
                mid = float(np.median(list(v.values())))
                mad = float(np.median([abs(x - mid) for x in v.values()]))
                found |= {(i, p) for i, x in v.items() if abs(x - mid) > tests.far * 1.4826 * mad}
    for key in {r[2] for r in once.values()}:
        own = sorted((r for r in once.values() if r[2] == key), key=lambda r: (r[3], r[0]))
        for p, s in itertools.product(range(2), range(len(own) - 7)):
            v = [own[i][4][p] if own[i][4] is not None else None for i in range(s, s + 8)]
            if all(x is not None and math.isfinite(x) for x in v) and float(np.float32(max(v))) - float(np.float32(min(v))) <= 0.002:
                found |= {(own[i][0], p) for i in range(s, s + 8)}
    return found


@pytest.mark.parametrize("open_rows", [60, 40_000])
def test_implausible_equals_brute_force(spark, open_rows):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        k = int(rng.integers(0, 3)) if rng.random() < 0.5 else 0
        x = [float(v) for v in rng.normal(size=2)]
        if rng.random() < 0.02:
            x[0] = 40.0
        if 200 <= i < 260:
            x[1], k = 1.0, 0
        if rng.random() < 0.03:
            x[1] = None if rng.random() < 0.5 else math.inf
        rows.append((i, None if k == 2 else f"s{k}", f"rec{k}", float(i // 2), None if rng.random() < 0.01 else x))
    rows += rows[:50] + [(None, "s0", "rec0", 1.0, [1.0, 2.0]), (10_000, "s0", None, 1.0, [99.0, 2.0])]
    df = spark.createDataFrame(rows, "row_idx long, src string, key string, t double, x array<double>").withColumn("seq", F.lit(1)).withColumn("lo", F.lit(1))
    tests = spikes.Tests()
    got = spikes.implausible(df, "row_idx", "src", "key", "t", "x", 2, tests, open_rows)
    assert {(r.row_id, r.pos) for r in got.where("far or kind in ('stuck', 'limit')").collect()} == _brute(rows, tests)
    assert spikes.implausible(df.limit(0), "row_idx", "src", "key", "t", "x", 2, tests).count() == 0


def _whole_sources(rows, tests):
    """Flags by the stated tests on each source's rows as one array."""
    found = set()
    for src in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == src), key=lambda r: r[2:4] + r[:1])
        ids, keys, x = [r[0] for r in own], [r[2] for r in own], np.array([r[4] or [None, None] for r in own], float).astype(np.float32).astype(float)
        seg = np.unique(keys, return_inverse=True)[1]
        mid, mad = spikes._mid_and_mad(x)
        phi = np.zeros(2)
        for _ in range(2):
            phi = spikes.coefficient(*spikes.lag_sums(x, seg, mid, mad, phi, tests))
        r, p, k, score, far = spikes.detect(x, seg, mid, mad, phi, tests)
        found |= {(ids[a], int(b), spikes.KINDS[c], float(d), bool(e)) for a, b, c, d, e in zip(r, p, k, score, far)}
    return found


def test_flags_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(17)
    rows = []
    for src, key, n in (("a", "a1", 1500), ("a", "a2", 7), ("b", "b1", 3), ("b", "b2", 300), ("c", "c1", 40), ("c", "c2", 900), ("d", "d1", 1)):
        z = 0.0
        for t in range(n):
            z = 0.8 * z + rng.normal()
            x = [float(z + (12 if 400 < t < 430 else 0)), 3.0 if 100 <= t < 120 else float(rng.normal())]
            if rng.random() < 0.02:
                x[0] += 30.0 if rng.random() < 0.5 else -30.0
            rows.append((len(rows), src, key, float(t // 2), None if rng.random() < 0.01 else x))
    df = spark.createDataFrame(rows, "row_idx long, src string, key string, t double, x array<double>")
    tests = spikes.Tests(high=(25.0, math.inf))
    want, before = _whole_sources(rows, tests), spark.conf.get("spark.sql.shuffle.partitions")
    assert {k for _, _, k, _, _ in want} == set(spikes.KINDS)
    try:
        for n, open_rows in ((2, 40_000), (16, 40_000), (48, 40_000), (3, 300)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = spikes.implausible(df, "row_idx", "src", "key", "t", "x", 2, tests, open_rows).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
