"""Feature datasets by source: policies beside them, completeness, guards, and paths named by hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.incremental import build_pending, file_system

#: Fields of a trial that change no result, and those that change no event or feature.
DISPLAY = frozenset({"run_name"})
TRAINING = frozenset({"training"})
POLICY = "feature-policy.json"


def _hash(fields: dict) -> str:
    return hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def trial_hashes(trial: dict) -> tuple[str, str]:
    """(hash of what shapes events and features, hash of all that shapes results)."""
    full = {k: v for k, v in trial.items() if k not in DISPLAY}
    return _hash({k: v for k, v in full.items() if k not in TRAINING}), _hash(full)


def run_paths(root: str, trial: dict, dataset: str) -> dict[str, str]:
    """Folders of a trial: events and features are shared by trials that differ in training only."""
    cache, full = trial_hashes(trial)
    run = f"{root}/{cache}"
    return {"run": run, "events": f"{run}/events", "features": f"{run}/features", "report": f"{run}/reports/{dataset}/{full}", "splits": f"{run}/splits/{dataset}/{full}"}


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, None where there is none."""
    fs, own = file_system(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(own) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, own = file_system(spark, path)
    out = fs.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()


def feature_policy(source: str, trial_hash: str, seconds: tuple[float, float], rates: dict[str, float] | None = None, max_gap_ms: int | None = None) -> dict:
    """What a source's features depend on; rates and gaps of the collector only."""
    quality = {"rates": dict(sorted((rates or {}).items())), "max_gap_ms": max_gap_ms}
    return {"version": 1, "source": source, "trial": trial_hash, "seconds": list(seconds), **({"quality": quality} if source == "collector" else {})}


def _parsed(text: str) -> object:
    """What a policy file holds; nothing if it is damaged, so its dataset is rebuilt."""
    try:
        return json.loads(text)
    except ValueError:
        return None


def check_domain(events: DataFrame, source: str) -> None:
    """An error unless all events belong to the source."""
    others = [r[0] for r in events.where("domain IS NOT NULL").select("domain").distinct().where(F.col("domain") != source).limit(5).collect()]
    if others:
        raise ValueError(f"feature source {source!r} got events of {', '.join(sorted(others))}")


def build_source(events: DataFrame, root: str, source: str, policy: dict, build: Callable[[DataFrame], DataFrame], incremental: bool = False) -> bool:
    """Features of one source below `root`; False if they were complete.

    A dataset of another policy is rebuilt, other sources stay. Of an incremental source pending
    sessions only are built; a partial dataset of another is rebuilt. No rows at all are an error.
    """
    spark = events.sparkSession
    check_domain(events, source)
    target, ledger = f"{root}/{source}", f"{root}/_ledger-{source}"
    wanted, held = json.dumps(policy, sort_keys=True, indent=2), read_text(spark, f"{root}/{source}-{POLICY}")
    fs, own = file_system(spark, target)
    if held is not None and _parsed(held) != policy:
        fs.delete(own, True)
        fs.delete(file_system(spark, ledger)[1], True)
    if not incremental and fs.exists(file_system(spark, f"{target}/_SUCCESS")[1]):
        return False
    write_text(spark, f"{root}/{source}-{POLICY}", wanted)
    if incremental:
        made = build_pending(events, target, ledger, build) > 0
    else:
        build(events).write.mode("overwrite").parquet(target)
        made = True
    if spark.read.parquet(target).isEmpty():
        fs.delete(own, True)
        raise ValueError(f"no feature rows for {source}")
    return made


def read_features(spark: SparkSession, root: str, source: str) -> DataFrame:
    """All parts of a source's features; none are an error."""
    fs, own = file_system(spark, f"{root}/{source}")
    if not fs.exists(own):
        raise FileNotFoundError(f"no features of {source} below {root}")
    return spark.read.parquet(f"{root}/{source}")
