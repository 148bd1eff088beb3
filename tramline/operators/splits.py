"""Leakage-free splits as membership tables, joined by group key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def impure(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """Groups with more than one value of a column: there must be none."""
    counts = df.groupBy(group).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])
    return counts.where(" OR ".join(f"n_{c} > 1" for c in columns))


def unknown_labels(df: DataFrame, labels: list[int]) -> DataFrame:
    """Label values that aren't configured."""
    return df.select("label").distinct().where(~F.col("label").isin(labels))


def mode_participants(df: DataFrame) -> DataFrame:
    """(label, participants)."""
    return df.groupBy("label").agg(F.count_distinct("participant_id").alias("participants"))


def check_groups(df: DataFrame, modes: dict[str, int], group: str, least: int = 2) -> None:
    """An error for groups of several labels, labels not configured, or modes of fewer than `least` groups; they are named."""
    if not impure(df, group, "label").isEmpty():
        raise ValueError(f"each {group} must have exactly one label")
    check_modes(df, modes, group, least)


def check_modes(df: DataFrame, modes: dict[str, int], group: str, least: int = 2) -> None:
    """An error for labels not configured, or modes of fewer than `least` groups; they are named."""
    found = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count_distinct(group).alias("n")).collect()}
    unknown = sorted(set(found) - set(modes.values()))
    if unknown:
        raise ValueError(f"label values not configured: {unknown}")
    sparse = [mode for mode, label in sorted(modes.items(), key=lambda x: (x[1], x[0])) if found.get(label, 0) < least]
    if sparse:
        raise ValueError(f"modes with fewer than {least} of {group}: {', '.join(sparse)}")


def numbered(groups: DataFrame, group: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (by, group) with `place`, from 0 on within `by`, in shuffled order, and `of`, how many there are; no task sees all groups.

    The first three hex digits of a group's key are its bucket: a place is a rank within the
    bucket and the rows of the buckets before, of which there are 4096 at most.
    """
    keyed = groups.select(*by, group).distinct().withColumn("key", S.shuffle_key(seed, group)).withColumn("bucket", F.substring("key", 1, 3))
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    before = keyed.groupBy(*by, "bucket").count().withColumn("before", F.sum("count").over(whole.orderBy("bucket")) - F.col("count")).withColumn("of", F.sum("count").over(whole))
    rank = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("key", group))
    return keyed.withColumn("rank", rank).join(before if by else F.broadcast(before), [*by, "bucket"]).select(*by, group, (F.col("rank") - 1 + F.col("before")).alias("place"), "of")


def holdout(df: DataFrame, fraction: float | dict[int, float], seed: int, group: str = "group_id", modes: dict[str, int] | None = None) -> DataFrame:
    """(label, group, role): in each label clamp(floor(n * fraction), 1, n - 1) groups calibrate, the rest are held out.

    `fraction`: one for all labels, or one for each. Every mode (every label, if no modes are
    given) must have two groups, and every group one label: else this is an error.
    """
    if modes is None:
        modes = {str(r["label"]): r["label"] for r in df.select("label").distinct().collect()}
    check_groups(df, modes, group)
    share = S.lookup(F.col("label"), fraction) if isinstance(fraction, dict) else F.lit(fraction)
    count = F.greatest(F.lit(1), F.least(F.floor(F.col("of") * share), F.col("of") - 1))
    return numbered(df, group, seed, ("label",)).select("label", group, F.when(F.col("place") < count, "calibration").otherwise("holdout").alias("role"))


def group_kfold(df: DataFrame, k: int, seed: int, group: str = "group_id") -> DataFrame:
    """(group, fold): groups in shuffled order, dealt round to min(k, groups) folds; sizes differ by one at most."""
    k = fold_count(df, k, group)
    return numbered(df, group, seed).select(group, (F.col("place") % k).cast("int").alias("fold"))


def fold_count(df: DataFrame, k: int, group: str) -> int:
    """min(k, groups); fewer than two are an error."""
    k = min(k, df.agg(F.count_distinct(group)).first()[0])
    if k < 2:
        raise ValueError(f"cross-validation needs at least two of {group}")
    return k


def leave_one_out(df: DataFrame, participant: str = "participant_id") -> DataFrame:
    """(fold, participant, role): each participant tests once and trains in all other folds."""
    own = df.select(F.col(participant)).distinct()
    return own.select(F.col(participant).alias("fold")).crossJoin(own).withColumn("role", F.when(F.col("fold") == F.col(participant), "test").otherwise("train"))


def fold_role(fold: Column, participant: Column) -> Column:
    """What a participant is to a fold of leave-one-out: rows carry their participant, so no table of pairs is needed."""
    return F.when(participant.eqNullSafe(fold), "test").otherwise("train")


def leave_one_out_sizes(df: DataFrame, participant: str = "participant_id", group: str = "group_id") -> DataFrame:
    """(fold, test_rows, train_rows, test_groups, train_groups): one row a participant; a group belongs to one participant."""
    own = df.groupBy(F.col(participant).alias("fold")).agg(F.count(F.lit(1)).alias("test_rows"), F.count_distinct(group).alias("test_groups"))
    # One row.
    all_ = own.agg(F.sum("test_rows").alias("_r"), F.sum("test_groups").alias("_g"))
    return own.crossJoin(F.broadcast(all_)).select("fold", "test_rows", (F.col("_r") - F.col("test_rows")).alias("train_rows"), "test_groups", (F.col("_g") - F.col("test_groups")).alias("train_groups"))


def profiles(df: DataFrame, scope: str | None = None, group: str = "participant_id") -> DataFrame:
    """(scope, grp, profile, counts): each group's rows by label, and these numbers cut to their first two binary digits.

    `counts` is a map; a profile is text. There are few profiles, however many groups there are.
    """
    named = df.withColumn("scope", F.col(scope) if scope else F.lit("all"))
    counts = named.groupBy("scope", F.col(group).cast("string").alias("grp"), "label").agg(F.count(F.lit(1)).alias("n"))
    low = F.pow(F.lit(2.0), F.floor(F.log2("n")) - 1)
    cut = F.when(F.col("n") < 4, F.col("n")).otherwise((F.floor(F.col("n") / low) * low).cast("bigint"))
    entry = F.struct(F.col("label").cast("string").alias("label"), cut.alias("cut"), F.col("n").alias("n"))
    own = counts.groupBy("scope", "grp").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    text = F.array_join(F.transform("_e", lambda e: F.concat_ws(":", e["label"], e["cut"].cast("string"))), ",")
    return own.select("scope", "grp", text.alias("profile"), F.map_from_entries(F.transform("_e", lambda e: F.struct(e["label"], e["n"]))).alias("counts"))


def dealt(rows: list[tuple[str, int, dict[str, float]]], k: int, what: str = "group") -> dict[str, list[int]]:
    """Folds of the groups of each profile beyond those dealt round: (profile, groups, mean counts by label) -> their folds.

    A profile's groups go round all folds as often as they can, which leaves the folds as even as before. Each of the rest goes where the label counts
    of folds stay most even; profiles of the largest spread first.
    """
    n = min(k, sum(c for _, c, _ in rows))
    if n < 2:
        raise ValueError(f"cross-validation needs at least two of {what}")
    labels = sorted({x for _, _, counts in rows for x in counts})
    table = np.array([[counts.get(x, 0.0) for x in labels] for _, _, counts in rows])
    total = np.array([c for _, c, _ in rows]) @ table
    folds, sizes, out = np.zeros((n, len(labels))), np.zeros(n), {}
    for i in sorted(range(len(rows)), key=lambda i: (-table[i].std(), rows[i][0])):
        own, rest = table[i] / total, []
        for _ in range(rows[i][1] % n):
            trial = [(np.std(np.vstack([folds[:f], folds[f] + own, folds[f + 1 :]]), axis=0).mean(), sizes[f], f) for f in range(n)]
            best = min(trial)[2]
            folds[best] += own
            sizes[best] += 1
            rest.append(best)
        out[rows[i][0]] = rest
    return out


def stratified_group_kfold(df: DataFrame, k: int, seed: int, scope: str | None = None, group: str = "participant_id") -> DataFrame:
    """(scope, group, fold): folds of a scope have groups of every profile of label counts, as evenly as they can.

    Folds are dealt to profiles, of which there are few; a group's fold is that of its shuffled place among those of its profile.
    There are min(k, groups) folds in a scope; fewer than two are an error.
    """
    each = profiles(df, scope, group)
    labels = F.explode("counts").alias("label", "n")
    means = each.select("scope", "profile", labels).groupBy("scope", "profile", "label").agg(F.sum("n").alias("n"))
    sizes = each.groupBy("scope", "profile").agg(F.count(F.lit(1)).alias("groups"))
    # A row for each profile and label.
    table = sizes.join(means, ["scope", "profile"])

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        own = [(p, int(g["groups"].iloc[0]), dict(zip(g["label"], (g["n"] / g["groups"]).astype(float), strict=True))) for p, g in rows.groupby("profile")]
        found = dealt(own, k, group)
        return pd.DataFrame({"scope": rows["scope"].iloc[0], "profile": list(found), "folds": min(k, sum(c for _, c, _ in own)), "rest": list(found.values())})

    folds = table.groupBy("scope").applyInPandas(deal, "scope string, profile string, folds int, rest array<int>")
    placed = numbered(each, "grp", seed, ("scope", "profile")).join(folds, ["scope", "profile"])
    whole = F.floor(F.col("of") / F.col("folds")) * F.col("folds")
    fold = F.when(F.col("place") < whole, (F.col("place") % F.col("folds")).cast("int")).otherwise(F.get("rest", (F.col("place") - whole).cast("int")))
    return placed.select("scope", F.col("grp").alias(group), fold.alias("fold"))
