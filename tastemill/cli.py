"""Command line: generate-synth, train, update, recommend, evaluate, profile. Results go to stdout as JSON."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from functools import reduce
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tastemill.functions.filters import PRESET, apply_filters, parse_value
from tastemill.operators import holdout, metrics, profile
from tastemill.plans import config, synthetic
from tastemill.plans.cores import Core, Dataset, RetrievalRequest, build_core
from tastemill.sources import tables

log = logging.getLogger("tastemill")


def log_level(args: argparse.Namespace) -> str:
    """An explicit level before quiet before verbose."""
    return args.log_level or ("WARNING" if args.quiet else "DEBUG" if args.verbose else "INFO")


def paths_of(args: argparse.Namespace) -> tables.DatasetPaths:
    """What is named on the command line, and for the rest the layout below the data root."""
    found = tables.default_paths(args.data_root, args.command, args.small_sample) if args.data_root else tables.DatasetPaths("", "", ())
    lacking = [n for n, own in (("--users", args.users or found.users), ("--items", args.items or found.items), ("--interactions", args.interactions or found.interactions)) if not own]
    if lacking:
        raise ValueError(f"{', '.join(lacking)} or --data-root is needed")
    return tables.DatasetPaths(args.users or found.users, args.items or found.items, tuple(args.interactions) or found.interactions, args.npz or found.embeddings)


def dataset(spark: SparkSession, args: argparse.Namespace, core: Core) -> Dataset:
    """Checked tables; batches of interactions restart with each file."""
    paths = paths_of(args)
    found = tables.load_dataset(spark, paths, core.params.get("batch_size") or 250_000)
    items = found["items"]
    if paths.embeddings:
        from tastemill.sources.npz import read_npz

        items = items.drop("embedding").join(read_npz(spark, paths.embeddings), "item_id", "left")
    return Dataset(found["users"], items, found["interactions"])


def core_of(args: argparse.Namespace) -> Core:
    c = config.load("core", args.core_config) if args.core_config else {"core_name": args.core, "params": {}}
    return build_core(c["core_name"], **c["params"])


def request_of(args: argparse.Namespace) -> RetrievalRequest:
    r = config.load("retrieval", args.retrieval_config) if args.retrieval_config else {}
    return RetrievalRequest(**r)


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    if args.command == "generate-synth":
        synthetic.write(spark, args.out, n_users=args.users_n, n_items=args.items_n, dim=args.dim, per_user=args.per_user, seed=args.seed)
        return {"written": args.out}
    if args.command in ("train", "update"):
        core = core_of(args)
        if args.command == "update":
            try:
                core.load(spark, args.model)
            except FileNotFoundError:
                log.warning("there is no model in %s yet: the update is a first fit", args.model)
        data = dataset(spark, args, core)
        (core.update if args.command == "update" else core.fit)(data)
        core.save(args.model_out or args.model)
        out = {"core": core.name, "model": args.model_out or args.model}
        return out | ({"export": core.export_reference(args.export)} if args.export else {})
    if args.command == "recommend":
        core = core_of(args).load(spark, args.model)
        asked = [int(u) for u in args.user_ids.split(",") if u.strip()]
        users = spark.createDataFrame([(u,) for u in asked], "user_id long")
        rows = {r["user_id"]: r for r in core.recommend_lists(users, args.k, request_of(args)).collect()}  # k numbers a requested user
        return {str(u): {"item_ids": list(rows[u]["item_ids"]), "scores": list(rows[u]["scores"])} for u in asked}
    if args.command == "evaluate":
        return evaluate(spark, args)
    paths, skipped = list(args.interactions), []
    rules = [[c, op, parse_value(v)] for c, op, v in args.filter] if args.filter else PRESET
    if args.split_root:
        paths = tables.split_files(spark, args.split_root, args.first) + paths
    paths, skipped = tables.with_columns_only(spark, paths, {"user_id", *(r[0] for r in rules)})
    if not paths:
        raise ValueError(f"no table has the columns of the filters; skipped: {skipped}")
    parts = [spark.read.parquet(p).withColumn("file", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for p in paths]
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    out = profile.distribution(profile.rows_per_user(apply_filters(df, rules, args.joined))).first().asDict() | {"skipped": len(skipped)}
    if args.report:
        items = spark.read.parquet(args.items) if args.items else None
        Path(args.report).write_text(json.dumps(out | profile.report(df, "file", items), indent=2, default=str), encoding="utf-8")
    return out


def evaluate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Metrics of a saved model; one that is not there, and the baselines always, are fitted first."""
    e = config.load("eval", args.eval_config)
    if e["positive_policy"] != "positives_only":
        raise ValueError("the only policy is positives_only")
    core = core_of(args)
    try:
        if core.name in ("popular", "random") or not args.model:
            raise FileNotFoundError
        core.load(spark, args.model)
    except FileNotFoundError:
        core.fit(dataset(spark, args, core))
    paths = paths_of(args)
    truth = holdout.merged_holdout(*[spark.read.parquet(p) for p in paths.interactions])
    if e["max_eval_users"]:
        truth = truth.join(F.broadcast(holdout.capped_users(truth, e["max_eval_users"])), "user_id", "left_semi")
    request = RetrievalRequest(**config.checked("retrieval", e["retrieval"])) if e["retrieval"] else RetrievalRequest()
    recs = core.recommend(truth.select("user_id").distinct(), e["k"], request)
    row = metrics.evaluate(recs, truth, spark.read.parquet(paths.items), e["k"]).first().asDict()
    n = row.pop("n_eval_users")
    return row | {"n_eval_users": n, "path": config.write_metrics(e["metrics_output_dir"], core.name, {"eval": e, "core": core.params}, row, n, e["k"], ",".join(paths.interactions))}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tastemill", description=__doc__)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--log-level")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate-synth")
    g.add_argument("out")
    for name, value in (("users-n", 2000), ("items-n", 1000), ("dim", 32), ("per-user", 20), ("seed", 42)):
        g.add_argument(f"--{name}", type=int, default=value)
    for name in ("train", "update", "recommend", "evaluate", "profile"):
        c = sub.add_parser(name)
        c.add_argument("--core", default="ema")
        c.add_argument("--core-config")
        c.add_argument("--model")
        c.add_argument("--model-out")
        c.add_argument("--users")
        c.add_argument("--items")
        c.add_argument("--npz")
        c.add_argument("--data-root", help="folder of the usual layout, for what is not named")
        c.add_argument("--small-sample", action="store_true", help="the first six weeks alone")
        c.add_argument("--export", help="train and update: also write the users' vectors here")
        c.add_argument("--interactions", nargs="*", default=[])
        c.add_argument("--user-ids", default="")
        c.add_argument("-k", type=int, default=20)
        c.add_argument("--retrieval-config")
        c.add_argument("--eval-config")
        c.add_argument("--filter", nargs=3, action="append", metavar=("COLUMN", "OP", "VALUE"))
        c.add_argument("--joined", choices=("and", "or"), default="or")
        c.add_argument("--report", help="profile: write the whole report to this JSON file")
        c.add_argument("--split-root", help="profile: read train and validation below this folder")
        c.add_argument("--first", type=int, help="profile: only the first so many files of the split")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=log_level(args), stream=sys.stderr)
    spark = SparkSession.builder.appName("tastemill").getOrCreate()
    print(json.dumps(run(spark, args)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
