"""Search: suggestions against a plain version, densities, rungs, scores."""

import math
import random

from tramline.operators import search
from tramline.operators.search import Choice, Number, Trial

SPACES = {"one": {"x": Number(0.0, 4.0), "k": Number(1, 9, step=2), "c": Choice(("a", "b", "c"))}, "two": {"y": Number(1e-4, 1.0, log=True)}}


def value(family, p):
    return -(p["x"] - 3) ** 2 - (p["k"] - 5) ** 2 / 8 - (p["c"] != "b") if family == "one" else -6 - abs(math.log10(p["y"]) + 2)


def run(n, seed, startup=10):
    done = []
    for i in range(n):
        family, p = search.suggest(SPACES, done, seed, i, startup)
        done.append(Trial("s", i, family, p, value(family, p), "pruned" if i % 7 == 3 else "complete", [0.0] * (1 + i % 3)))
    return done


def normal(x, m, s):
    return math.exp(-(((x - m) / s) ** 2) / 2) / (s * math.sqrt(2 * math.pi))


def cdf(x, m, s):
    return (1 + math.erf((x - m) / s / math.sqrt(2))) / 2


def plain_density(seen, x):
    """Gaussians about each of the points, cut off at 0 and 1, and a wide one."""
    points, total = sorted(seen), normal(x, 0.5, 1) / (cdf(1, 0.5, 1) - cdf(0, 0.5, 1))
    for i, m in enumerate(points):
        left, right = (points[i - 1] if i else 0.0), (points[i + 1] if i + 1 < len(points) else 1.0)
        s = min(1.0, max(1 / min(100, len(points) + 2), m - left, right - m))
        total += normal(x, m, s) / (cdf(1, m, s) - cdf(0, m, s))
    return total / (len(points) + 1)


def test_densities():
    rng = random.Random(2)
    for n in (0, 1, 5, 40):
        seen = [rng.random() for _ in range(n)]
        own = search.Mixture(seen)
        grid = [(i + 0.5) / 2000 for i in range(2000)]
        assert abs(sum(map(own.density, grid)) / 2000 - 1) < 1e-3
        assert all(math.isclose(own.density(x), plain_density(seen, x), rel_tol=1e-9) for x in grid[::50])
        assert all(0 <= own.draw(rng) <= 1 for _ in range(200))
    own = search.Counts(("a", "b"), ["a", "a", "b"])
    assert math.isclose(own.density("a"), 2.5 / 4) and math.isclose(own.density("b"), 1.5 / 4)


def test_suggestions_equal_a_plain_version():
    """Each parameter's suggestion is the one of its candidates with the largest ratio of plain densities."""
    done = run(30, 5)
    best = sorted(done, key=lambda t: (t.state == "pruned", -len(t.steps) if t.state == "pruned" else 0, -t.score, t.number))
    good, bad = best[:3], best[3:]
    for number in range(30, 40):
        family, p = search.suggest(SPACES, done, 5, number)
        rng = random.Random(f"5-{number}")
        share = lambda trials, f: (sum(t.family == f for t in trials) + 0.5) / (len(trials) + 1)  # noqa: B023, E731
        drawn = [search.Counts(("one", "two"), [t.family for t in good]).draw(rng) for _ in range(24)]
        assert family == max(drawn, key=lambda f: math.log(share(good, f) / share(bad, f)))
        for k, own in SPACES[family].items():
            near, far = ([t.parameters[k] for t in part if t.family == family] for part in (good, bad))
            if isinstance(own, Choice):
                odds = lambda seen, v: (seen.count(v) + 1 / 3) / (len(seen) + 1)  # noqa: B023, E731
                drawn = [search.Counts(own.values, near).draw(rng) for _ in range(24)]
                assert p[k] == max(drawn, key=lambda v: math.log(odds(near, v) / odds(far, v)))  # noqa: B023
            else:
                near, far = [own.share(x) for x in near], [own.share(x) for x in far]
                drawn = [search.Mixture(near).draw(rng) for _ in range(24)]
                assert p[k] == own.at(max(drawn, key=lambda x: math.log(plain_density(near, x) / plain_density(far, x))))  # noqa: B023


def test_suggestions_are_seeded_and_better_than_chance():
    assert [(t.family, t.parameters) for t in run(25, 3)] == [(t.family, t.parameters) for t in run(25, 3)] != [(t.family, t.parameters) for t in run(25, 4)]
    late = [max(t.score for t in run(40, seed)[20:]) for seed in range(8)]
    chance = [max(t.score for t in run(40, seed, startup=99)[20:]) for seed in range(8)]
    assert sum(late) > sum(chance)
    for t in run(60, 1):
        for k, own in SPACES[t.family].items():
            assert t.parameters[k] in own.values if isinstance(own, Choice) else own.low <= t.parameters[k] <= own.high
            if k == "k":
                assert t.parameters[k] % 2 == 1


def test_numbers():
    steps = Number(200, 800, step=100)
    assert {steps.at(i / 1000) for i in range(1001)} == set(range(200, 801, 100)) and all(abs(steps.at(steps.share(x)) - x) < 1e-9 for x in range(200, 801, 100))
    log = Number(1e-4, 1e-2, log=True)
    assert math.isclose(log.at(0.5), 1e-3) and math.isclose(log.share(1e-3), 0.5)
    assert all(set(own) for own in search.SPACES.values())


def test_rungs():
    rungs = search.Rungs("s", 9)
    assert rungs.brackets == 3 and [rungs.shares[b] for b in range(3)] == [9, 5, 3]
    many = [rungs.bracket(i) for i in range(2000)]
    assert all(abs(many.count(b) / 2000 - rungs.shares[b] / 17) < 0.05 for b in range(3))
    first = [i for i in range(2000) if many[i] == 0][:6]
    scores = [0.5, 0.4, 0.6, 0.55, 0.7, 0.65]
    # The best third of those that came to the rung go on, the best one always.
    assert [rungs.behind(i, 1, x) for i, x in zip(first, scores, strict=True)] == [False, True, False, True, False, False]
    assert not rungs.behind(first[0], 2, 0.0) and not rungs.behind(next(i for i in range(2000) if many[i] == 2), 3, 0.0)


def test_scores():
    matrix = {(0, 0): 3, (0, 1): 1, (1, 1): 2, (1, 0): 2}
    assert search.matrix_score(matrix, [0, 1], "accuracy") == 5 / 8 and search.matrix_score(matrix, [0, 1], "minimum_class_recall") == 0.5
    assert math.isclose(search.matrix_score(matrix, [0, 1], "macro_f1"), (6 / 9 + 4 / 7) / 2) and search.matrix_score(matrix, [0, 1, 2], "balanced_accuracy") == 1.25 / 3
