"""Recommender cores behind one interface: fit, update, recommend, save, load, export.

A core's state is DataFrames; saving writes them as Parquet under the model's folder, loading reads them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.operators import ema, graph, kmeans, popularity, retrieval, towers


@dataclass(frozen=True)
class RetrievalRequest:
    mode: str = "bruteforce_full"
    ann_enabled: bool = False
    subset_size: int | None = None
    random_seed: int = 42
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass
class Dataset:
    """interactions need ord for the order-dependent cores; items an embedding for those that use content."""

    users: DataFrame
    items: DataFrame
    interactions: DataFrame


class Core:
    name = ""
    defaults: dict[str, Any] = {}
    tables: tuple[str, ...] = ()

    def __init__(self, **params: Any):
        """Unknown parameters of shared configurations (folders, batch sizes of other cores) are kept but not used."""
        self.params = self.defaults | {k: v for k, v in params.items() if v is not None}
        self.state: dict[str, DataFrame] = {}

    def fit(self, data: Dataset) -> Core:
        raise NotImplementedError

    def update(self, data: Dataset) -> Core:
        return self.fit(data)

    def recommend(self, users: DataFrame, k: int, request: RetrievalRequest = RetrievalRequest()) -> DataFrame:
        """user_id, rank, item_id, score; a user without a vector has no rows."""
        mine = self.state["users"].join(users.select("user_id").distinct(), "user_id", "left_semi")
        nprobe = int(request.extra.get("nprobe") or 0) if request.ann_enabled else 0
        return retrieval.retrieve(request.mode, mine, self.state["items"], k, self._subset(request), nprobe)

    def recommend_lists(self, users: DataFrame, k: int, request: RetrievalRequest = RetrievalRequest()) -> DataFrame:
        """user_id, item_ids, scores in order of rank, for every requested user; empty lists where there is nothing."""
        found = self.recommend(users, k, request).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("best"))
        rows = users.select("user_id").distinct().join(found, "user_id", "left")
        of = lambda name, kind: F.coalesce(F.col(f"best.{name}"), F.array().cast(f"array<{kind}>")).alias(f"{name}s")
        return rows.select("user_id", of("item_id", "long"), of("score", "double"))

    def _subset(self, request: RetrievalRequest) -> DataFrame | None:
        if not request.mode.endswith("_subset"):
            return None
        return popularity.item_subset(self.state["items"], request.subset_size, request.random_seed)

    def export(self, path: str | None = None) -> DataFrame:
        """user_id, embedding in ascending id; with a path also written there, as export_reference tells."""
        if "users" not in self.state:
            raise NotImplementedError(f"{self.name} has no user vectors")
        return self._exported(self.state["users"], path)

    @staticmethod
    def _exported(vectors: DataFrame, path: str | None) -> DataFrame:
        rows = vectors.select("user_id", "embedding").orderBy("user_id")
        if path is None:
            return rows
        rows.write.mode("overwrite").parquet(path)
        return vectors.sparkSession.read.parquet(path)

    def export_reference(self, path: str) -> dict[str, Any]:
        """Exports and says what lies where."""
        row = self.export(path).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
        return {"core": self.name, "path": path, "n_users": row["n"], "embed_dim": row["dim"] or 0}

    def save(self, folder: str) -> None:
        """Every table is written beside its old version, which goes only when all are written; then the state reads them."""
        spark, mark = next(iter(self.state.values())).sparkSession, uuid.uuid4().hex
        for name, df in self.state.items():
            df.write.parquet(f"{folder}/.{name}-{mark}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name in self.state:
            new = path(f"{folder}/{name}.parquet")
            files.delete(new, True)
            if not files.rename(path(f"{folder}/.{name}-{mark}"), new):
                raise OSError(f"{new} could not be put in place")
        self.load(spark, folder)

    def load(self, spark: SparkSession, folder: str) -> Core:
        try:
            self.state = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in self.tables}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise FileNotFoundError(f"no {self.name} model in {folder}") from e
        return self


class EmaCore(Core):
    name, tables = "ema", ("users", "items")
    defaults = {"embed_dim": 32, "batch_size": 250_000, "ema_alpha": 0.95, "score_weights": None}

    def _fold(self, data: Dataset) -> tuple[DataFrame, DataFrame]:
        p = self.params
        items = data.items.select("item_id", F.slice(F.col("embedding").cast("array<double>"), 1, p["embed_dim"]).alias("embedding")).dropDuplicates(["item_id"])
        return items, ema.fold(ema.batch_profiles(data.interactions, items, p["embed_dim"], p["batch_size"], p["score_weights"]), p["embed_dim"], p["ema_alpha"])

    def fit(self, data: Dataset) -> Core:
        items, folded = self._fold(data)
        self.state = {"users": folded.select("user_id", "embedding"), "items": items}
        return self

    def update(self, data: Dataset) -> Core:
        if not self.state:
            return self.fit(data)
        items, folded = self._fold(data)
        self.state = {"users": ema.update(self.state["users"], folded, self.params["ema_alpha"]), "items": items}
        return self


class OnlineKMeansCore(Core):
    name, tables = "online_kmeans", ("centers", "items")
    defaults = {"embed_dim": 64, "k_centers": 4, "drift_alpha": 0.05, "seed": 42}

    def fit(self, data: Dataset, state: DataFrame | None = None) -> Core:
        p = self.params
        items = data.items.select("item_id", F.slice(F.col("embedding").cast("array<double>"), 1, p["embed_dim"]).alias("embedding")).dropDuplicates(["item_id"])
        centers = kmeans.fit_centers(data.interactions, items, p["k_centers"], p["embed_dim"], p["drift_alpha"], p["seed"], state)
        self.state = {"centers": centers, "items": items}
        return self

    def update(self, data: Dataset) -> Core:
        return self.fit(data, self.state.get("centers"))

    def recommend(self, users: DataFrame, k: int, request: RetrievalRequest = RetrievalRequest()) -> DataFrame:
        if not retrieval.supports_mode(request.mode):
            raise ValueError(f"unknown retrieval mode {request.mode!r}")
        mine = self.state["centers"].join(users.select("user_id").distinct(), "user_id", "left_semi")
        items, subset = self.state["items"], self._subset(request)
        if subset is not None:
            items = items.join(F.broadcast(subset), "item_id", "left_semi")
        return kmeans.recommend(mine, items, k)

    def export(self, path: str | None = None) -> DataFrame:
        return self._exported(kmeans.mean_center(self.state["centers"], self.params["embed_dim"]), path)


class GcnCore(Core):
    """Propagation over the user-item graph from the items' content vectors; `stub` gives seeded latents instead."""

    name, tables = "gcn", ("users", "items")
    defaults = {"embed_dim": 64, "epochs": 2, "layers": 2, "stub": False, "seed": 42}

    def fit(self, data: Dataset) -> Core:
        p = self.params
        items = data.items.select("item_id", F.slice(F.col("embedding").cast("array<double>"), 1, p["embed_dim"]).alias("embedding")).dropDuplicates(["item_id"])
        if p["stub"]:
            latents = graph.seeded_latents(items, "item_id", p["embed_dim"], p["epochs"], p["seed"])
            users = graph.seeded_latents(data.interactions.where("user_id is not null"), "user_id", p["embed_dim"], p["epochs"], p["seed"] + 1000)
            vectors = graph.apply_map(users, "user_id", graph.fit_map(latents, items))
        else:
            vectors = graph.light_gcn(data.interactions, items, p["embed_dim"], p["layers"])
        self.state = {"users": vectors, "items": items}
        return self


class TwoTowerCore(Core):
    name, tables = "two_tower", ("users", "items")
    defaults = {"embed_dim": 64, "epochs": 2, "scoring": "cosine"}

    def fit(self, data: Dataset) -> Core:
        d, e = self.params["embed_dim"], self.params["epochs"]
        content = data.items.select("item_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null").dropDuplicates(["item_id"])
        self.state = {"users": towers.user_tower(data.users, d, e), "items": towers.item_tower(data.items.drop("embedding"), content, d, e)}
        return self


class PopularCore(Core):
    """The state has the counts of all items; ranks and scores are made for the k that is asked for."""

    name, tables = "popular", ("counts",)
    defaults = {"min_positive_score": 2}

    def fit(self, data: Dataset) -> Core:
        ix = data.interactions
        if "train_interactions_rank" in data.items.columns:
            counts = data.items.select("item_id", (-F.col("train_interactions_rank")).alias("n"))
        elif "score" in ix.columns:
            counts = popularity.by_score(ix, self.params["min_positive_score"])
        else:
            counts = popularity.by_impressions(ix)
        self.state = {"counts": counts}
        return self

    def recommend(self, users: DataFrame, k: int, request: RetrievalRequest = RetrievalRequest()) -> DataFrame:
        return popularity.popular_for_users(users, self.state["counts"], k)


class RandomCore(Core):
    name, tables = "random", ("items",)
    defaults = {"seed": 42}

    def fit(self, data: Dataset) -> Core:
        self.state = {"items": data.items.select("item_id")}
        return self

    def recommend(self, users: DataFrame, k: int, request: RetrievalRequest = RetrievalRequest()) -> DataFrame:
        return popularity.random_items(users, self.state["items"], k, self.params["seed"])


CORES = {c.name: c for c in (EmaCore, OnlineKMeansCore, GcnCore, TwoTowerCore, PopularCore, RandomCore)}


def build_core(name: str, **params: Any) -> Core:
    if name not in CORES:
        raise ValueError(f"unknown core {name!r}; known: {', '.join(CORES)}")
    if isinstance(params.get("score_weights"), dict):  # JSON has text keys
        params["score_weights"] = {int(k): float(v) for k, v in params["score_weights"].items()}
    return CORES[name](**params)
