"""JSON configurations of cores, retrieval and evaluation: required keys, types, defaults."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

RULES: dict[str, dict[str, tuple[bool, type | tuple[type, ...]]]] = {
    "core": {"core_name": (True, str), "params": (True, dict)},
    "retrieval": {"mode": (True, str), "ann_enabled": (False, bool), "subset_size": (False, int), "random_seed": (False, int), "extra": (False, dict)},
    "eval": {"k": (True, int), "positive_policy": (True, str), "metrics_output_dir": (True, str), "retrieval": (False, dict), "recommend_chunk_size": (False, int), "max_eval_users": (False, int)},
}
#: An explicit null stays null. Fixed values of the interface.
DEFAULTS: dict[str, dict[str, Any]] = {
    "core": {},
    "retrieval": {"ann_enabled": False, "random_seed": 42, "extra": {}},
    "eval": {"retrieval": {}, "recommend_chunk_size": 10_000, "max_eval_users": 10_000},
}


def checked(kind: str, values: dict[str, Any]) -> dict[str, Any]:
    for key, (required, types) in RULES[kind].items():
        if required and key not in values:
            raise ValueError(f"{kind} config lacks {key!r}")
        if values.get(key) is not None and not isinstance(values[key], types):
            raise TypeError(f"{kind} config: {key!r} is {type(values[key]).__name__}")
    return DEFAULTS[kind] | values


def load(kind: str, path: str) -> dict[str, Any]:
    values = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(values, dict):
        raise ValueError(f"{path} is not a JSON object")
    return checked(kind, values)


def stable_hash(values: Any) -> str:
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()[:16]


def write_metrics(folder: str, core: str, config: dict[str, Any], metrics: dict[str, float], n_users: int, k: int, data_slice: str) -> str:
    """Writes {core}_{UTC time}_{hash}.metrics.json and returns its path."""
    at, digest = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ"), stable_hash(config)
    body = {
        "run_meta": {"core_name": core, "config_hash": digest, "data_slice": data_slice, "k": k, "timestamp": at},
        "metrics": {f"{m}_at_k": metrics[m] for m in ("precision", "recall", "map", "ndcg", "coverage")} | {"n_eval_users": n_users},
    }
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{core}_{at}_{digest}.metrics.json"
    path.write_text(json.dumps(body, indent=2, sort_keys=True), encoding="utf-8")
    return str(path)
