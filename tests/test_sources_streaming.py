import json
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tastemill import cli
from tastemill.operators import ema, kmeans
from tastemill.plans import synthetic
from tastemill.sources import npz, tables
from tastemill.streaming import ema_stream


def test_npz(spark, tmp_path):
    p = str(tmp_path / "e.npz")
    v = np.arange(60, dtype=np.float16).reshape(10, 6)
    np.savez(p, item_id=np.arange(10, dtype=np.uint32), embedding=v)
    df = npz.read_npz(spark, p, dim=4, partitions=3)
    got = {r["item_id"]: r["embedding"] for r in df.collect()}
    assert len(got) == 10 and got[3] == v[3, :4].tolist()
    with pytest.raises(Exception, match="elements"):
        npz.read_npz(spark, p, dim=7).collect()


def test_npz_compressed_and_slices(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(25_000, 3)).astype(np.float32)
    for save in (np.savez, np.savez_compressed):
        save(tmp_path / "e.npz", item_id=np.arange(25_000, dtype=np.uint32), embedding=v)
        got = npz.read_npz(spark, f"file://{tmp_path}/e.npz", partitions=2).orderBy("item_id").toArrow()
        assert np.array_equal(np.stack(got["embedding"].to_numpy()), v) and got["item_id"].to_pylist() == list(range(25_000))
    np.savez(tmp_path / "f.npz", item_id=np.arange(3), embedding=np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="by columns"):
        npz.read_npz(spark, str(tmp_path / "f.npz")).collect()


def test_npz_names(spark, tmp_path):
    v = np.ones((3, 2), np.float32)
    for k, arrays in enumerate(({"ids": np.arange(3)}, {"weird": np.arange(3)})):
        np.savez(tmp_path / f"{k}.npz", embedding=v, **arrays)
        assert npz.read_npz(spark, str(tmp_path / f"{k}.npz")).count() == 3
    np.savez(tmp_path / "x.npz", embedding=v, a=np.arange(3), b=np.arange(3))
    with pytest.raises(Exception, match="no array of ids"):
        npz.read_npz(spark, str(tmp_path / "x.npz")).collect()


def test_layout_and_dialects():
    files, held = tables.week_layout("r")
    assert len(files) == 25 and files[24].endswith("train/week_24.parquet") and held.endswith("validation/week_25.parquet")
    small, held = tables.week_layout("r", small=True)
    assert len(small) == 6 and held == small[5]
    assert tables.default_paths("r", "evaluate").interactions == (tables.week_layout("r")[1],) and len(tables.default_paths("r", "train", True).interactions) == 6
    assert tables.dialect(["user_id", "item_id", "score"]) == "legacy" and tables.dialect(["user_id", "item_id"]) == "interactions"
    with pytest.raises(ValueError):
        tables.dialect(["user_id"])


def test_discover_and_split(spark, tmp_path):
    for k in (0, 1):
        spark.range(5 + k).coalesce(1).write.parquet(str(tmp_path / f"a/train/week_{k:02d}.parquet"))
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "a/validation/week_02.parquet"))
    for p in sorted(tmp_path.glob("a/*/*.parquet")):  # one file a week, as the pattern looks at files
        part = next(p.glob("part-*.parquet")).read_bytes()
        shutil.rmtree(p)
        p.write_bytes(part)
    (tmp_path / "a/train/other.parquet").write_bytes((tmp_path / "a/train/week_00.parquet").read_bytes())
    got = tables.discover(spark, str(tmp_path / "a")).groupBy("week").agg(F.count(F.lit(1)).alias("n"), F.max("row_index").alias("last")).orderBy("week").collect()
    assert [tuple(r) for r in got] == [(0, 5, 4), (1, 6, 5), (2, 3, 2)]
    names = [p.rsplit("/", 1)[1] for p in tables.split_files(spark, str(tmp_path / "a"))]
    assert names == ["other.parquet", "week_00.parquet", "week_01.parquet", "week_02.parquet"] and len(tables.split_files(spark, str(tmp_path / "a"), 2)) == 2


def test_load_checks_and_orders(spark, tmp_path):
    """Batches restart with each file, and do not depend on how a file is split."""
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "item_id int, embedding array<double>")
    items.write.parquet(str(tmp_path / "items"))
    spark.range(4).select(F.col("id").cast("int").alias("user_id")).write.parquet(str(tmp_path / "users"))
    weeks = []
    for k in range(3):
        rows = [(o % 4, (o + k) % 6, 2) for o in range(25 + k)]
        spark.createDataFrame(rows, "user_id int, item_id int, score int").coalesce(1).write.parquet(str(tmp_path / f"w{2 - k}"))
        weeks.append(str(tmp_path / f"w{2 - k}"))
    paths = tables.DatasetPaths(str(tmp_path / "users"), str(tmp_path / "items"), tuple(weeks))
    found = tables.load_dataset(spark, paths, 10)
    ix = found["interactions"]
    assert dict(ix.dtypes)["user_id"] == "bigint" and ix.select("ord").distinct().count() == 78
    batches = [r["count"] for r in ix.groupBy(F.expr("ord div 10").alias("b")).count().orderBy("b").collect()]
    assert batches == [10, 10, 5, 10, 10, 6, 10, 10, 7]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        again = tables.load_dataset(spark, paths, 10)["interactions"]
        assert sorted(map(tuple, again.select("ord", "user_id", "item_id").collect())) == sorted(map(tuple, ix.select("ord", "user_id", "item_id").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    items.select("item_id").write.parquet(str(tmp_path / "bare"))
    with pytest.raises(ValueError, match="embedding"):
        tables.load_dataset(spark, tables.DatasetPaths(paths.users, str(tmp_path / "bare"), paths.interactions))
    with pytest.raises(ValueError, match="items lack"):
        tables.load_dataset(spark, tables.DatasetPaths(paths.users, paths.users, paths.interactions, "e.npz"))
    assert tables.with_columns_only(spark, [weeks[0], paths.users], {"user_id", "score"}) == ([weeks[0]], [paths.users])


def test_synthetic(spark):
    d = synthetic.generate(spark, 20, 60, 8, 5)
    rows = d["interactions"].collect()
    assert len(rows) == 100 and {r["score"] for r in rows} <= {0, 1, 2, 3}
    assert all((r["event_type"] == "positive") == (r["score"] >= 2) for r in rows)
    with pytest.raises(ValueError):
        synthetic.generate(spark, 5, 10)


def test_stream_equals_batch(spark, tmp_path):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id long, embedding array<double>")
    ix = spark.createDataFrame([(o, o % 3, o % 5, 2) for o in range(40)], "ord long, user_id long, item_id long, score int").coalesce(1)
    src, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    ix.where("ord < 20").write.parquet(src)
    ema_stream.stream_ema(ema_stream.interaction_stream(spark, src, ix.schema), items, state, ck, 2, batch_size=10).awaitTermination()
    ix.where("ord >= 20").write.mode("append").parquet(src)
    ema_stream.stream_ema(ema_stream.interaction_stream(spark, src, ix.schema), items, state, ck, 2, batch_size=10).awaitTermination()
    got = {r["user_id"]: r["embedding"] for r in ema_stream.latest(spark, state).collect()}
    want = {r["user_id"]: r["embedding"] for r in ema.ema_vectors(ix, items, 2, batch_size=10).collect()}
    assert len(got) == 3 and all(np.allclose(got[u], want[u]) for u in want)


def test_stream_of_centres_and_progress(spark, tmp_path):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id long, embedding array<double>")
    flags = {f: F.lit(False) for f in ("dislike", "share", "bookmark", "click_on_author", "open_comments")}
    ix = spark.range(60).select(F.col("id").alias("ord"), (F.col("id") % 3).alias("user_id"), (F.col("id") % 5).alias("item_id"), F.lit(40).alias("timespent"), F.lit(True).alias("like")).withColumns(flags).coalesce(1)
    src, state, ck = (str(tmp_path / x) for x in ("in", "state", "ck"))
    said = []
    listener = ema_stream.Progress(lambda *x: said.append(x))
    spark.streams.addListener(listener)
    try:
        for at in range(0, 60, 10):
            ix.where((F.col("ord") >= at) & (F.col("ord") < at + 10)).write.mode("append").parquet(src)
            ema_stream.stream_kmeans(ema_stream.interaction_stream(spark, src, ix.schema), items, state, ck, 2, 2).awaitTermination()
        for _ in range(100):
            if any("rows" in x[0] for x in said):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = {r["user_id"]: r["centers"] for r in ema_stream.latest(spark, state).collect()}
    want = {r["user_id"]: r["centers"] for r in kmeans.fit_centers(ix, items, 2, 2).collect()}
    assert len(got) == 3 and all(np.allclose(got[u], want[u]) for u in want)
    assert len(ema_stream._versions(spark, state)) == 3 and any("rows" in x[0] for x in said)


def test_command_line(spark, tmp_path):
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    d = tmp_path / "d"
    run("generate-synth", d, "--users-n", 10, "--items-n", 60, "--dim", 8, "--per-user", 6)
    core = tmp_path / "c.json"
    core.write_text(json.dumps({"core_name": "ema", "params": {"embed_dim": 8, "score_weights": {"0": -0.05, "1": 1, "2": 2, "3": 3}}}))
    files = ["--users", d / "users.parquet", "--items", d / "items.parquet", "--interactions", d / "interactions.parquet"]
    run("train", "--core-config", core, "--model", tmp_path / "m", *files)
    out = run("recommend", "--core-config", core, "--model", tmp_path / "m", "--user-ids", "1,2,99", "-k", 3)
    assert len(out["1"]["item_ids"]) == 3 and out["99"]["item_ids"] == []
    stats = run("profile", "--interactions", d / "interactions.parquet", "--filter", "score", ">=", "2")
    assert stats["rows"] == spark.read.parquet(str(d / "interactions.parquet")).where("score >= 2").count()
    assert spark.read.parquet(str(d / "items.parquet")).select(F.size("embedding")).first()[0] == 8
    assert run("update", "--core-config", core, "--model", tmp_path / "m", "--export", tmp_path / "x", *files)["export"]["n_users"] == 10
    with pytest.raises(ValueError, match="--items"):
        run("train", "--users", d / "users.parquet")


def test_evaluate_loads_or_fits(spark, tmp_path):
    run = lambda *a: cli.run(spark, cli.parser().parse_args([str(x) for x in a]))
    root = tmp_path / "root"
    flags = {f: F.lit(False) for f in ("dislike", "share", "bookmark", "click_on_author", "open_comments")}
    ix = spark.range(200).select((F.col("id") % 7).alias("user_id"), (F.col("id") * 3 % 20).alias("item_id"), F.lit(50).alias("timespent"), (F.col("id") % 2 == 0).alias("like")).withColumns(flags)
    for path in tables.week_layout(str(root), small=True)[0]:
        ix.coalesce(1).write.parquet(path)
    spark.range(7).toDF("user_id").write.parquet(f"{root}/{tables.USERS}")
    spark.range(20).toDF("item_id").write.parquet(f"{root}/{tables.ITEMS}")
    np.savez(tmp_path / "e.npz", item_id=np.arange(20), embedding=np.random.default_rng(0).normal(size=(20, 4)).astype(np.float32))
    (root / tables.EMBEDDINGS).write_bytes((tmp_path / "e.npz").read_bytes())
    e = tmp_path / "e.json"
    e.write_text(json.dumps({"k": 5, "positive_policy": "positives_only", "metrics_output_dir": str(tmp_path / "out"), "retrieval": {"mode": "ann_full", "ann_enabled": True, "extra": {"nprobe": 100}}}))
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"core_name": "ema", "params": {"embed_dim": 4, "batch_size": 50}}))
    layout = ("--data-root", root, "--small-sample", "--eval-config", e)
    first = run("evaluate", "--core-config", c, "--model", tmp_path / "none", *layout)
    run("train", "--core-config", c, "--model", tmp_path / "m", "--data-root", root, "--small-sample")
    assert {k: v for k, v in run("evaluate", "--core-config", c, "--model", tmp_path / "m", *layout).items() if k != "path"} == {k: v for k, v in first.items() if k != "path"}
    assert first["n_eval_users"] == 7 and 0 < first["precision"] <= 1
    assert run("evaluate", "--core", "popular", "--model", tmp_path / "m", *layout)["n_eval_users"] == 7
    report = tmp_path / "r.json"
    out = run("profile", "--split-root", root / "subsamples/ur0.1", "--first", 2, "--interactions", f"{root}/{tables.USERS}", "--report", report)
    assert out["skipped"] == 1 and len(json.loads(report.read_text())["files"]) == 2
