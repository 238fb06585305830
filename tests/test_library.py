"""Hand-computed values and invariants."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill.functions import feedback, filters, vectors
from tastemill.operators import ema, kmeans, metrics, popularity, retrieval
from tastemill.plans import config
from tastemill.plans.cores import CORES, Dataset, RetrievalRequest, build_core

FLAGS = "timespent int, like boolean, dislike boolean, share boolean, bookmark boolean, click_on_author boolean, open_comments boolean"


def flags(spark, *rows):
    return spark.createDataFrame([(t, like, dis, eng, False, False, False) for t, eng, like, dis in rows], FLAGS)


def test_scores(spark):
    df = flags(spark, (39, False, False, False), (40, False, False, False), (80, False, False, False), (255, False, False, False), (0, True, False, False), (0, False, True, False), (255, True, True, True), (None, None, None, None))
    assert [r[0] for r in df.select(feedback.feedback_score()).collect()] == [0, 1, 2, 2, 1, 2, 0, 0]


def test_positive(spark):
    df = flags(spark, (30, False, False, False), (31, False, False, False), (None, False, None, None), (31, False, False, True))
    assert [r[0] for r in df.select(feedback.positive_flag()).collect()] == [False, True, False, True]
    assert df.where(feedback.is_positive()).count() == 2


def test_weights(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (2,), (9,)], "s int")
    assert [r[0] for r in df.select(feedback.score_weight(F.col("s"), {"0": -0.5, 2: 4, -3: 9})).collect()] == [-0.5, -0.5, 0.0, 4.0, 4.0]


def test_filter_language(spark):
    df = spark.createDataFrame([(1, True), (3, False), (None, None)], "a int, b boolean")
    assert sorted(map(str, (r["a"] for r in filters.apply_filters(df, [["a", "not_in", [1, 2]]]).collect()))) == ["3", "None"]
    assert filters.apply_filters(df, [["a", "!=", 1]]).count() == 1
    assert filters.apply_filters(df, [["b", "==", 1]]).count() == 1
    assert filters.apply_filters(df, [["a", "==", 1], ["b", "==", 0]], "or").count() == 2
    assert filters.apply_filters(df, []).count() == 3
    assert filters.apply_filters(df, [["a", "is_null"]]).count() == 1
    for bad in ([["a", "like", 1]], [["a", "=="]]):
        with pytest.raises(ValueError):
            filters.apply_filters(df, bad)
    assert filters.parse_value("[1]") == [1] and filters.parse_value("x") == "x"


def test_metrics(spark):
    recs = spark.createDataFrame([(1, i + 1, i + 1) for i in range(4)] + [(2, 1, 7)], "user_id long, rank long, item_id long")
    truth = spark.createDataFrame([(1, 2), (1, 4), (1, 9), (2, 7), (3, 5)], "user_id long, item_id long")
    m = {r["user_id"]: r for r in metrics.user_metrics(recs, truth, 4).collect()}
    assert m[1]["precision"] == 0.5 and math.isclose(m[1]["recall"], 2 / 3) and math.isclose(m[1]["map"], 1 / 3)
    assert abs(m[1]["ndcg"] - 0.498189) < 1e-6
    assert m[2]["precision"] == m[2]["recall"] == m[2]["map"] == m[2]["ndcg"] == 1.0
    assert m[3]["precision"] == m[3]["ndcg"] == 0
    assert metrics.evaluate(recs.limit(0), truth.limit(0), truth, 4).first()["n_eval_users"] == 0


IX = "ord long, user_id long, item_id long, score int"


def test_ema_values_and_increment(spark):
    items = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "item_id long, embedding array<double>")
    ix = spark.createDataFrame([(0, 1, 1, 1), (10, 1, 2, 1)], IX)
    whole = ema.ema_vectors(ix, items, 1, batch_size=10)
    assert math.isclose(whole.first()["embedding"][0], 0.1475)
    one = ema.ema_vectors(spark.createDataFrame([(0, 1, 1, 2), (1, 1, 3, 0)], IX), items, 1, batch_size=10).first()
    assert abs(one["embedding"][0] - 0.0451220) < 1e-6
    first, later = ix.where("ord < 10"), ix.where("ord >= 10")
    state = ema.ema_vectors(first, items, 1, batch_size=10)
    assert math.isclose(ema.update(state, ema.fold(ema.batch_profiles(later, items, 1, 10), 1)).first()["embedding"][0], 0.1475)


def test_kmeans_step_and_stream_of_rows(spark):
    out = kmeans.moved(np.array([[0.0], [5.0]]), np.array([1.0]), 0.1)
    assert np.allclose(out, [[0.135], [4.5]])
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id long, embedding array<double>")
    rows = [(o, u, 1 + (o + u) % 2, 40, True, False, False, False, False, False) for o in range(20) for u in range(5)]
    ix = spark.createDataFrame(rows, "ord long, user_id long, item_id long, timespent int, like boolean, dislike boolean, share boolean, bookmark boolean, click_on_author boolean, open_comments boolean")
    whole = {r["user_id"]: r["centers"] for r in kmeans.fit_centers(ix, items, 2, 2).collect()}
    half = kmeans.fit_centers(ix.where("ord < 10"), items, 2, 2)
    both = {r["user_id"]: r["centers"] for r in kmeans.fit_centers(ix.where("ord >= 10"), items, 2, 2, state=half).collect()}
    assert len(whole) == 5 and all(np.allclose(whole[u], both[u]) for u in whole)


def test_kmeans_rows_in_many_batches(spark):
    """Users that go on over batch borders, one hot user, and a state: the same as one user's rows one by one."""
    rng = np.random.default_rng(8)
    vectors_ = rng.normal(size=(30, 3))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors_)], "item_id long, embedding array<double>")
    rows = [(o, 2**60 + 7 if o % 3 else int(rng.integers(0, 9)), int(rng.integers(0, 30))) for o in range(600)]
    flags = ["like", "dislike", "share", "bookmark", "click_on_author", "open_comments"]
    ix = spark.createDataFrame(rows, "ord long, user_id long, item_id long").withColumns({"timespent": F.lit(40), **{f: F.lit(False) for f in flags}})
    old = spark.createDataFrame([(3, [[1.0, 2.0, 3.0]] * 2), (100, [[0.5, 0.5, 0.5]] * 2)], "user_id long, centers array<array<double>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r["user_id"]: np.array(r["centers"]) for r in kmeans.fit_centers(ix, items, 2, 3, 0.05, 42, old).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    users = {u for _, u, _ in rows} | {3, 100}
    assert set(got) == users
    for u in users:
        c = np.array({3: [[1.0, 2.0, 3.0]] * 2, 100: [[0.5, 0.5, 0.5]] * 2}.get(u)) if u in (3, 100) else kmeans.first_centers(u, 2, 3, 42)
        for _, v, i in sorted(rows):
            if v == u:
                near = np.argmin(np.linalg.norm(c - vectors_[i], axis=1))
                c[near] = 0.85 * c[near] + 0.15 * vectors_[i]
                c = c * 0.95
        assert np.allclose(got[u], c, rtol=1e-12)


def test_kmeans_recommends_by_whole_ids_and_all_centres(spark):
    """Ids above 2 ** 53, and more centres than 64."""
    rng = np.random.default_rng(9)
    m, c = rng.normal(size=(40, 4)), rng.normal(size=(70, 4))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id long, embedding array<double>")
    users = [123456789012345678, 123456789012345679, 1, 2]
    centers = spark.createDataFrame([(u, np.roll(c, k, axis=1)[: 70 - k].tolist()) for k, u in enumerate(users)], "user_id long, centers array<array<double>>")
    got = {(r["user_id"], r["rank"]): r["item_id"] for r in kmeans.recommend(centers, items, 6).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for k, u in enumerate(users):
        own = np.roll(c, k, axis=1)[: 70 - k]
        score = (unit @ (own / np.linalg.norm(own, axis=1, keepdims=True)).T).max(axis=1)
        assert [got[u, r] for r in range(1, 7)] == np.lexsort((np.arange(40), -np.round(score, 9)))[:6].tolist()
    assert len(got) == 24


def test_popular_scores(spark):
    counts = spark.createDataFrame([(i, 10 - i) for i in range(6)], "item_id long, n long")
    assert [round(r["score"], 6) for r in popularity.top_items(counts, 4).orderBy("rank").collect()] == [1.0, 0.7, 0.4, 0.1]
    assert popularity.top_items(counts, 1).first()["score"] == 1.0
    assert popularity.top_items(counts, 0).count() == 0


def test_tile_and_norm(spark):
    r = spark.range(1).select(vectors.tiled([F.lit(1), F.lit(2), F.lit(3)], 5), vectors.normalized(F.array(F.lit(0.0), F.lit(0.0)))).first()
    assert r[0] == [1, 2, 3, 1, 2] and r[1] == [0, 0]


@pytest.mark.parametrize("block_bytes", [1 << 28, 300])
def test_retrieval_blocks(spark, block_bytes):
    rng = np.random.default_rng(0)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)] + [(50, [0.0] * 4)], "item_id long, embedding array<double>")
    users = items.where("item_id < 7").withColumnRenamed("item_id", "user_id")
    got = retrieval.top_k(users, items, 5, block_bytes).orderBy("user_id", "rank").collect()
    m = np.array([r["embedding"] for r in items.orderBy("item_id").collect()])
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    for u in range(7):
        want = np.lexsort((np.arange(51), -np.round(unit @ unit[u], 9)))[:5]
        assert [r["item_id"] for r in got if r["user_id"] == u] == want.tolist()
    assert retrieval.top_k(users, items, 0).count() == 0
    with pytest.raises(ValueError):
        retrieval.retrieve("nearest", users, items, 5)


def test_retrieval_ties_and_tiles(spark, monkeypatch):
    """Equal vectors are ranked by id, over tiles and blocks."""
    monkeypatch.setattr(retrieval, "TILE_ITEMS", 7)
    items = spark.createDataFrame([(200 - i, [float(i % 4), 1.0]) for i in range(100)], "item_id long, embedding array<double>")
    users = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0])], "user_id long, embedding array<double>")
    for size in (1 << 20, 300):
        got = [(r["user_id"], r["item_id"]) for r in retrieval.top_k(users, items, 30, size).orderBy("user_id", "rank").collect()]
        for u, best in ((1, (0, 1)), (2, (3, 2))):
            assert [i for v, i in got if v == u] == [i for c in best for i in sorted(200 - j for j in range(100) if j % 4 == c)][:30]


def test_retrieval_passes_items_over(spark, monkeypatch):
    """Users alike: the items that meet them are few, and the result is that of all products. Empty, zero and odd vectors as well."""
    rng = np.random.default_rng(7)
    m = rng.normal(size=(20_000, 8))
    m[::500], m[1::500] = 0, m[2::500]
    v = np.vstack([[1.0, 2, 3, 0, 0, 0, 0, 0] + 1e-3 * rng.normal(size=(900, 8)), rng.normal(size=(40, 8)), np.zeros((1, 8))])
    met, add = [], retrieval.Best.add
    monkeypatch.setattr(retrieval.Best, "add", lambda self, score, place, ids: (met.append(score.size), add(self, score, place, ids))[1])
    unit, asked = retrieval.unit_rows(m), retrieval.unit_rows(v)
    score = asked @ unit.T
    want = np.argsort(-(np.rint(score * 10**9).astype(np.int64) << 32) + np.arange(len(m)), axis=1, kind="stable")[:, :20]
    for at, centre, radius in retrieval.groups(asked):
        best = retrieval.Best(len(at), 20)
        for x in range(0, len(m), 5000):
            few = best.may_enter(unit[x : x + 5000] @ centre, radius)
            if len(few):
                best.add(asked[at] @ unit[x : x + 5000][few].T, x + few, x + few)
        assert (best.item == want[at]).all()
    assert sorted(np.concatenate([at for at, _, _ in retrieval.groups(asked)])) == list(range(len(v))) and sum(met) < 0.2 * score.size
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "item_id long, embedding array<double>")
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "user_id long, embedding array<double>")
    for size in (1 << 28, 400_000):
        got = retrieval.top_k(users, items, 20, size).orderBy("user_id", "rank").toPandas()
        assert (got["item_id"].to_numpy().reshape(-1, 20) == want).all()


def test_coarse_cells_have_recall(spark):
    """Recall against brute force at a fifth of the cells, and exactness at all of them; most items lie in one place."""
    rng = np.random.default_rng(10)
    m = np.vstack([rng.normal(size=(40, 16)).repeat(25, axis=0) + 0.3 * rng.normal(size=(1000, 16)), np.ones((500, 16)) + 0.1 * rng.normal(size=(500, 16))])
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "item_id long, embedding array<double>")
    users = spark.createDataFrame([(u, (m[u * 13] + 0.1).tolist()) for u in range(60)], "user_id long, embedding array<double>")
    rows = lambda df: {(r["user_id"], r["rank"], r["item_id"]) for r in df.collect()}
    want = rows(retrieval.top_k(users, items, 10))
    assert rows(retrieval.top_k_by_cells(users, items, 10, 39, 39, per_part=100)) == want
    found = {(u, i) for u, _, i in rows(retrieval.top_k_by_cells(users, items, 10, 8, 39))}
    assert len(found & {(u, i) for u, _, i in want}) >= 0.9 * len(want)
    assert rows(retrieval.retrieve("ann_full", users, items, 10, nprobe=1000)) == want and retrieval.supports_mode("ann_full") and not retrieval.supports_mode("x")


def test_random_and_subset(spark):
    items, users = spark.range(200).toDF("item_id"), spark.range(10).toDF("user_id")
    r = popularity.random_items(users, items, 20)
    assert r.count() == 200 and r.distinct().count() == 200 and r.groupBy("user_id").agg(F.countDistinct("item_id").alias("n")).where("n <> 20").count() == 0
    assert popularity.item_subset(items, 200) is None and popularity.item_subset(items, None) is None
    assert popularity.item_subset(items, 7).collect() == popularity.item_subset(items, 7).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257])
def test_shuffled_numbers(spark, n):
    users = spark.createDataFrame([(0, 1), (1, n), (2, 5 * n)], "user_id long, size long")
    got = popularity.shuffled_numbers(users, n, 42).orderBy("position").collect()
    for u, size in ((0, 1), (1, n), (2, n)):
        own = [r["number"] for r in got if r["user_id"] == u]
        assert len(set(own)) == len(own) >= size and set(own) <= set(range(n))
    assert n < 100 or own != [r["number"] for r in got if r["user_id"] == 1]


def test_negatives_are_whole(spark):
    items = spark.range(100).toDF("item_id")
    users = spark.createDataFrame([(u,) for u in (0, 1, 2, 3, 4, None)], "user_id long")
    n_seen = {0: 0, 1: 50, 2: 95, 3: 99, 4: 100}
    seen = [(u, (i * 7 + u) % 100) for u, m in n_seen.items() for i in range(m)]
    ix = spark.createDataFrame([*seen, *seen[:20], (1, 555), (9, 1)], "user_id long, item_id long")
    for k in (1, 20, 60, 120):
        got = [tuple(r) for r in popularity.negatives(users, items, ix, k).collect()]
        assert len(set(got)) == len(got) and not set(got) & set(seen) and {i for _, i in got} <= set(range(100))
        assert [sum(g[0] == u for g in got) for u in (0, 1, 2, 3, 4, None)] == [min(k, 100 - n_seen.get(u, 0)) for u in (0, 1, 2, 3, 4, None)]
    assert popularity.negatives(users, items, ix, 0).count() == 0 and popularity.negatives(users, items.limit(0), ix, 5).count() == 0


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"mode": "ann_full", "subset_size": None}))
    assert config.load("retrieval", str(p)) == {"ann_enabled": False, "random_seed": 42, "extra": {}, "mode": "ann_full", "subset_size": None}
    with pytest.raises(ValueError):
        config.checked("core", {"params": {}})
    with pytest.raises(TypeError):
        config.checked("eval", {"k": "20", "positive_policy": "x", "metrics_output_dir": "y"})
    path = config.write_metrics(str(tmp_path), "ema", {"a": 1}, dict.fromkeys(("precision", "recall", "map", "ndcg", "coverage"), 0.5), 3, 20, "week")
    assert json.loads(open(path).read())["metrics"]["n_eval_users"] == 3 and config.stable_hash({"a": 1}) in path


@pytest.mark.parametrize("name", sorted(CORES))
def test_cores_round_trip(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, i, i % 5, i + 1, rng.normal(size=4).tolist()) for i in range(30)], "item_id long, author_id long, duration int, train_interactions_rank long, embedding array<double>")
    users = spark.createDataFrame([(u, 20 + u, u % 2, u, u + 1) for u in range(6)], "user_id long, age int, gender int, geo int, train_interactions_rank long")
    rows = [(o, o % 6, (o * 7) % 30, 40, o % 3 == 0, False, False, False, False, False) for o in range(60)]
    ix = spark.createDataFrame(rows, "ord long, user_id long, item_id long, timespent int, like boolean, dislike boolean, share boolean, bookmark boolean, click_on_author boolean, open_comments boolean")
    core = build_core(name, embed_dim=4, batch_size=10, work_dir="ignored")
    core.fit(Dataset(users, items, ix))
    folder = str(tmp_path / name)
    core.save(folder)
    again = build_core(name, embed_dim=4).load(spark, folder)
    for mode, size in (("bruteforce_full", None), ("ann_subset", 12)):
        request = RetrievalRequest(mode, subset_size=size)
        a = core.recommend(users, 5, request).orderBy("user_id", "rank").collect()
        b = again.recommend(users, 5, request).orderBy("user_id", "rank").collect()
        assert [(r["user_id"], r["rank"], r["item_id"]) for r in a] == [(r["user_id"], r["rank"], r["item_id"]) for r in b]
        assert len(a) == 30 and all(1 <= r["rank"] <= 5 for r in a)
    before = [tuple(r) for r in again.recommend(users, 5).orderBy("user_id", "rank").collect()]
    again.save(folder)  # over what it was read from
    assert [tuple(r) for r in again.recommend(users, 5).orderBy("user_id", "rank").collect()] == before
    lists = {r["user_id"]: r for r in again.recommend_lists(users.unionByName(spark.createDataFrame([(77,)], "user_id long"), allowMissingColumns=True), 5).collect()}
    assert len(lists) == 7 and all(len(lists[u]["item_ids"]) == 5 for u in range(6)) and (name in ("popular", "random")) == (len(lists[77]["item_ids"]) == 5)
    if name in ("popular", "random"):
        with pytest.raises(NotImplementedError):
            again.export()
    else:
        assert again.export_reference(str(tmp_path / "out")) == {"core": name, "path": str(tmp_path / "out"), "n_users": 6, "embed_dim": 4}
        assert [r["user_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == list(range(6))
    with pytest.raises(FileNotFoundError):
        build_core(name).load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        build_core("sasrec")


def test_popular_core_keeps_all_items(spark, tmp_path):
    items = spark.range(1500).select(F.col("id").alias("item_id"), (1500 - F.col("id")).alias("train_interactions_rank"))
    users, ix = spark.range(2).toDF("user_id"), spark.range(3).select(F.col("id").alias("user_id"), F.col("id").alias("item_id"))
    build_core("popular").fit(Dataset(users, items, ix)).save(str(tmp_path / "m"))
    core = build_core("popular").load(spark, str(tmp_path / "m"))
    for k in (1, 1200, 1500, 2000):
        few = min(k, 1500)
        got = core.recommend(users, k).where("user_id = 1").orderBy("rank").collect()
        assert [(r["rank"], r["item_id"]) for r in got] == [(i + 1, 1499 - i) for i in range(few)]
        assert np.allclose([r["score"] for r in got], np.linspace(1.0, 0.1, few))
    assert core.recommend(users, 0).count() == 0


def test_synthetic_rows_have_pools_of_their_own(spark):
    from tastemill.plans import synthetic

    rng = np.random.default_rng(3)
    m = rng.normal(size=(120, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "item_id long, embedding array<double>")
    users = items.where("item_id < 3").withColumnRenamed("item_id", "user_id")
    got = synthetic.noisy_picks(users, items, 300, 7).collect()
    for u in range(3):
        own = [r for r in got if r["user_id"] == u]
        x = m[u] @ m.T + synthetic.NOISE * synthetic.noise(synthetic.row_keys(7, np.full(300, u), np.arange(1, 301)), np.arange(120))
        assert len(own) == 300 and len({r["item_id"] for r in own}) > synthetic.POOL
        for r, row in zip(own, x):
            assert math.isclose(row[r["item_id"]], r["affinity"], abs_tol=1e-9) and (row > r["affinity"] + 1e-9).sum() < synthetic.POOL
    assert sorted((*r[:2], round(r[2], 9)) for r in synthetic.noisy_picks(users, items, 300, 7, block_bytes=2000).collect()) == sorted((*r[:2], round(r[2], 9)) for r in got)
    z = synthetic.noise(synthetic.row_keys(1, np.arange(400), np.arange(400)), np.arange(500))
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    rows = synthetic.generate(spark, n_users=10, n_items=200, per_user=400)["interactions"]
    assert rows.count() == 4000 and rows.groupBy("user_id").agg(F.countDistinct("item_id").alias("n")).where(F.col("n") <= synthetic.POOL).count() == 0


def test_random_items_are_whole(spark):
    users = spark.range(300).toDF("user_id")
    for n, k in ((20, 20), (60, 60), (20, 25), (1, 3)):
        r = popularity.random_items(users, spark.range(n).toDF("item_id"), k)
        per = r.groupBy("user_id").agg(F.countDistinct("item_id").alias("n"), F.countDistinct("rank").alias("r"), F.max("rank").alias("last"), F.sum("score").alias("s")).collect()
        assert len(per) == 300 and all((p["n"], p["r"], p["last"]) == (min(n, k),) * 3 and math.isclose(p["s"], 1) for p in per)


def test_popular_beyond_a_list(spark, monkeypatch):
    """All items as rows have the ranks and scores that one list gives, ties, a null item and null counts included."""
    rows = [(None if i == 7 else i * 37 % 500, None if i % 100 == 3 else i % 6, i % 4) for i in range(500)]
    counts, users = spark.createDataFrame(rows, "item_id long, n long, first int"), spark.range(2).toDF("user_id")
    found = lambda df: sorted(((r["user_id"], r["rank"], r["item_id"], r["score"]) for r in df.collect()), key=lambda r: r[:2])
    for c in (counts, counts.drop("first"), counts.limit(1)):
        want = [found(popularity.popular_for_users(users, c, k)) for k in (10, 600)]
        monkeypatch.setattr(popularity, "LISTED", 5)
        assert [found(popularity.popular_for_users(users, c, k)) for k in (10, 600)] == want
        monkeypatch.undo()


def test_map_is_fitted_on_all_items(spark):
    from tastemill.operators import graph

    n = 210_000
    x = F.array(F.sin("id"), F.cos("id") + 0.5)
    far = F.when(F.col("id") % 21 == 0, -50.0).otherwise(2.0)
    both = spark.range(n).select(F.col("id").alias("item_id"), x.alias("latent"), F.transform(x, lambda v: v * far).alias("embedding"))
    i = np.arange(n)
    m = np.stack([np.sin(i), np.cos(i) + 0.5], axis=1)
    y = m * np.where(i % 21 == 0, -50.0, 2.0)[:, None]
    want = np.linalg.solve(m.T @ m + 1e-3 * np.eye(2), m.T @ y)
    assert np.allclose(graph.fit_map(both.select("item_id", "latent"), both.select("item_id", "embedding")), want, rtol=1e-9)


def test_numbered(spark):
    """Places by (value, id) as one sort gives them; most rows have one value."""
    from tastemill.sources import tables

    rows = [(i * 37 % 1000, 0 if i % 3 else i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "item_id long, c int")
    got = {r["item_id"]: r["place"] for r in tables.numbered(df, -F.col("c"), "item_id", "place", per_range=50).collect()}
    assert got == {i: k + 1 for k, (_, i) in enumerate(sorted((-c, i) for i, c in rows))}


def test_samples_shares_and_reports(spark):
    from tastemill.operators import holdout, profile

    flags = {f: F.lit(False) for f in ("dislike", "share", "bookmark", "click_on_author", "open_comments")}
    ix = spark.range(60).select((F.col("id") % 6).alias("user_id"), (F.col("id") * 7 % 20).alias("item_id"), F.lit(40).alias("timespent"), (F.col("id") % 2 == 0).alias("like"), F.concat(F.lit("f"), F.col("id") % 3).alias("file")).withColumns(flags)
    pairs = holdout.holdout_pairs(ix)
    assert [(r["user_id"], len(r["items"])) for r in holdout.sample(pairs, 2, 3).orderBy("user_id").collect()] == [(0, 3), (1, 3)]
    assert holdout.merged_holdout(ix.where("file = 'f0'"), ix.where("file <> 'f0'")).count() == pairs.count()
    recs = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (9, 1, 0)], "user_id long, rank long, item_id long")
    had = {(i % 6, i * 7 % 20) for i in range(60)}
    assert math.isclose(metrics.interaction_share(recs, ix, 2).first()["share"], sum(x in had for x in ((0, 0), (0, 1), (9, 0))) / 3)
    assert metrics.interaction_share(recs.limit(0), ix, 2).first()["share"] == 0
    r = profile.report(ix, "file", spark.createDataFrame([(1, [1.0, float("nan")]), (1, [1.0, 2.0]), (2, None)], "item_id long, embedding array<double>"))
    assert [f["rows"] for f in r["files"]] == [20, 20, 20] and r["totals"]["rows_median"] == 20 and r["totals"]["rows"] == 60 and r["totals"]["positives"] == 60
    assert r["items"]["duplicates"] == 1 and r["items"]["nan_fraction"] == 0.25 and r["rows_per_user"]["users"] == 6
    assert profile.over_files(profile.per_file(ix.limit(0), "file")).first()["rows_max"] == 0
    json.dumps(r)
