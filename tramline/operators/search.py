"""Search for hyper-parameters: density ratios over finished trials, and stopping at rungs.

Only parameters, scores and states of trials are held here, at the driver; trials themselves are fits
and counts in Spark (see protocols).
"""

from __future__ import annotations

import math
import random
import zlib
from dataclasses import dataclass, field
from statistics import NormalDist


@dataclass(frozen=True)
class Choice:
    """One of some values."""

    values: tuple


@dataclass(frozen=True)
class Number:
    """A number from low to high: by its logarithm, or whole steps from low on."""

    low: float
    high: float
    log: bool = False
    step: int = 0

    def share(self, x: float) -> float:
        """Where x lies between the bounds, from 0 to 1; steps have half a step on either side."""
        if self.log:
            return math.log(x / self.low) / math.log(self.high / self.low)
        half = self.step / 2
        return (x - self.low + half) / (self.high - self.low + 2 * half)

    def at(self, share: float) -> float:
        if self.log:
            return self.low * (self.high / self.low) ** share
        half = self.step / 2
        x = self.low - half + share * (self.high - self.low + 2 * half)
        return x if not self.step else int(self.low + self.step * min(max(0, round((x - self.low) / self.step)), (self.high - self.low) // self.step))


#: What the surveyed search draws from, with the nearest parameters of MLlib.
SPACES: dict[str, dict[str, Choice | Number]] = {
    "random_forest": {"numTrees": Number(200, 800, step=100), "maxDepth": Choice((30, 8, 12, 16, 24)), "minInstancesPerNode": Choice((1, 2, 4, 8)), "featureSubsetStrategy": Choice(("sqrt", "log2", "0.5", "0.8"))},
    "gradient_boosting": {
        "maxIter": Number(200, 1200, step=100), "stepSize": Number(0.02, 0.2, log=True), "maxDepth": Number(3, 8, step=1), "minInstancesPerNode": Number(1, 10, step=1), "subsamplingRate": Number(0.6, 1.0),
        "featureSubsetStrategy": Choice(("0.5", "0.6", "0.7", "0.8", "0.9", "1.0")), "minInfoGain": Number(0, 5),
    },
    "multilayer_perceptron": {"hidden": Choice(("64", "128", "64_32", "128_64")), "stepSize": Number(1e-4, 5e-3, log=True), "blockSize": Choice((32, 64, 128, 256)), "maxIter": Number(100, 300, step=50), "tol": Number(1e-4, 1e-3, log=True)},
}


@dataclass
class Trial:
    """A trial of a study: `steps` has the score after each fold, `score` the last one; state is complete or pruned."""

    study: str
    number: int
    family: str
    parameters: dict
    score: float = 0.0
    state: str = "complete"
    steps: list[float] = field(default_factory=list)


def ordered(trials: list[Trial]) -> list[Trial]:
    """Best first: complete ones by score, then pruned ones by steps and score; the earlier of equals."""
    return sorted(trials, key=lambda t: (t.state != "complete", -len(t.steps) if t.state != "complete" else 0, -t.score, t.number))


class Mixture:
    """A density on 0 to 1: a wide normal for what isn't known, and one about each observation, as wide as the gap to its neighbours."""

    def __init__(self, seen: list[float]):
        points = sorted(seen)
        least = 1 / min(100, len(points) + 2)
        ends = [0.0, *points, 1.0]
        self.parts = [(0.5, 1.0)] + [(x, min(1.0, max(least, x - ends[i], ends[i + 2] - x))) for i, x in enumerate(points)]

    def density(self, x: float) -> float:
        total = 0.0
        for mean, width in self.parts:
            own = NormalDist(mean, width)
            total += own.pdf(x) / (own.cdf(1) - own.cdf(0))
        return total / len(self.parts)

    def draw(self, rng: random.Random) -> float:
        own = NormalDist(*rng.choice(self.parts))
        low, high = own.cdf(0), own.cdf(1)
        return min(1.0, max(0.0, own.inv_cdf(min(max(low + rng.random() * (high - low), 1e-12), 1 - 1e-12))))


class Counts:
    """Shares of values, each seen once more than it was."""

    def __init__(self, values: tuple, seen: list):
        self.values, self.weights = values, [seen.count(v) + 1 / len(values) for v in values]

    def density(self, x: object) -> float:
        return self.weights[self.values.index(x)] / sum(self.weights)

    def draw(self, rng: random.Random) -> object:
        return rng.choices(self.values, self.weights)[0]


def _chosen(own: Choice | Number, good: list, bad: list, rng: random.Random, candidates: int) -> object:
    """Of candidates drawn where good trials are dense, the one whose density among good ones is highest against bad ones."""
    if isinstance(own, Choice):
        near, far = Counts(own.values, good), Counts(own.values, bad)
    else:
        near, far = Mixture([own.share(x) for x in good]), Mixture([own.share(x) for x in bad])
    drawn = [near.draw(rng) for _ in range(candidates)]
    best = max(drawn, key=lambda x: math.log(near.density(x)) - math.log(far.density(x)))
    return best if isinstance(own, Choice) else own.at(best)


def suggest(spaces: dict[str, dict[str, Choice | Number]], finished: list[Trial], seed: int, number: int, startup: int = 10, candidates: int = 24, share: float = 0.1, most: int = 25) -> tuple[str, dict]:
    """(family, parameters) of the next trial; the same for equal seeds, numbers and finished trials.

    The first `startup` trials are drawn evenly. Then the family is chosen first, and its parameters by the
    trials of that family. Good ones are the best `share` of the trials, `most` at most.
    """
    rng = random.Random(f"{seed}-{number}")
    families = Choice(tuple(spaces))
    if len(finished) < startup:
        family = rng.choice(families.values)
        return family, {k: rng.choice(x.values) if isinstance(x, Choice) else x.at(rng.random()) for k, x in spaces[family].items()}
    best = ordered(finished)
    cut = min(most, math.ceil(share * len(best)))
    good, bad = best[:cut], best[cut:]
    family = _chosen(families, [t.family for t in good], [t.family for t in bad], rng, candidates)
    values = lambda trials, k: [t.parameters[k] for t in trials if t.family == family]
    return family, {k: _chosen(x, values(good, k), values(bad, k), rng, candidates) for k, x in spaces[family].items()}


class Rungs:
    """Stops trials that fall behind: brackets of rungs after 1, eta, eta^2, ... folds.

    A trial belongs to a bracket by the hash of its study and number; brackets that stop early take more trials. At a
    rung, a trial goes on if it is among the best 1 / eta that came there (the best one always does).
    """

    def __init__(self, study: str, folds: int, eta: int = 3):
        self.study, self.eta = study, eta
        self.brackets = 1
        while eta**self.brackets <= folds:
            self.brackets += 1
        self.shares = [math.ceil(self.brackets * eta ** (self.brackets - 1 - b) / (self.brackets - b)) for b in range(self.brackets)]
        self.seen: dict[tuple[int, int], list[float]] = {}

    def bracket(self, number: int) -> int:
        at = zlib.crc32(f"{self.study}_{number}".encode()) % sum(self.shares)
        return next(b for b in range(self.brackets) if at < sum(self.shares[: b + 1]))

    def behind(self, number: int, steps: int, score: float) -> bool:
        """Note a trial's score after so many folds: whether to stop it."""
        own = self.bracket(number)
        if steps not in [self.eta**r for r in range(own, self.brackets)]:
            return False
        scores = self.seen.setdefault((own, steps), [])
        scores.append(score)
        return score < sorted(scores, reverse=True)[max(len(scores) // self.eta, 1) - 1]


def matrix_score(matrix: dict[tuple[int, int], int], labels: list[int], metric: str) -> float:
    """macro_f1 or minimum_class_recall (or accuracy, balanced_accuracy) of confusion counts (truth, prediction) -> n."""
    hit = {x: matrix.get((x, x), 0) for x in labels}
    true = {x: sum(n for (t, _), n in matrix.items() if t == x) for x in labels}
    said = {x: sum(n for (_, p), n in matrix.items() if p == x) for x in labels}
    recall = [hit[x] / true[x] if true[x] else 0.0 for x in labels]
    if metric == "minimum_class_recall":
        return min(recall)
    if metric == "balanced_accuracy":
        return sum(recall) / len(recall)
    if metric == "accuracy":
        return sum(hit.values()) / max(1, sum(true.values()))
    if metric == "macro_f1":
        return sum(2 * hit[x] / (true[x] + said[x]) if true[x] + said[x] else 0.0 for x in labels) / len(labels)
    raise ValueError(f"unknown metric {metric}")
