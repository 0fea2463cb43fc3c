"""Parameter search that learns from earlier trials.

Trials are drawn in rounds and a round is evaluated together. The first round
is a seeded random draw. Then the trials so far are parted by loss into the
best quarter and the rest; over each parameter both parts get a smoothed
distribution (a bell over the range around every trial's value, and a uniform
share), and the next round takes the untried candidates drawn from the good
distribution where good over bad is greatest.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

Trial = tuple[int, ...]


def _density(values: list[int], space: Sequence[int], width: float) -> list[float]:
    """Smoothed shares of ``space``: bells around the values and a uniform one."""
    share = [1.0 / len(space)] * len(space)
    for v in values:
        bell = [math.exp(-0.5 * ((x - v) / width) ** 2) for x in space]
        total = sum(bell)
        share = [s + b / total for s, b in zip(share, bell)]
    return [s / (len(values) + 1) for s in share]


def propose(spaces: Sequence[Sequence[int]], tried: dict[Trial, float], n: int, rng: random.Random,
            good_share: float = 0.25, candidates: int = 24) -> list[Trial]:
    """Up to ``n`` untried points, each the best of ``candidates`` draws from the
    good trials' distribution by the ratio of good to bad."""
    ranked = sorted(tried, key=lambda t: (tried[t], t))
    cut = max(1, math.ceil(good_share * len(ranked)))
    good, bad = ranked[:cut], ranked[cut:]
    dens = []
    for i, space in enumerate(spaces):
        width = max(1.0, len(space) / max(2.0, math.sqrt(len(ranked))))
        dens.append((_density([t[i] for t in good], space, width), _density([t[i] for t in bad], space, width)))
    out: list[Trial] = []
    left = math.prod(len(s) for s in spaces) - len(tried)
    while len(out) < min(n, left):
        best = None
        for _ in range(candidates):
            at = [rng.choices(range(len(s)), weights=d[0])[0] for s, d in zip(spaces, dens)]
            point = tuple(s[j] for s, j in zip(spaces, at))
            if point in tried or point in out:
                continue
            ratio = sum(math.log(d[0][j] / d[1][j]) for d, j in zip(dens, at))
            if best is None or ratio > best[0]:
                best = (ratio, point)
        if best is None:  # the good region is used up: a random untried point
            point = tuple(rng.choice(s) for s in spaces)
            if point in tried or point in out:
                continue
            best = (0.0, point)
        out.append(best[1])
    return out


def random_draw(spaces: Sequence[Sequence[int]], n: int, rng: random.Random) -> list[Trial]:
    """``n`` distinct points, evenly drawn."""
    out: dict[Trial, None] = {}
    while len(out) < min(n, math.prod(len(s) for s in spaces)):
        out[tuple(rng.choice(s) for s in spaces)] = None
    return list(out)


def minimise(spaces: Sequence[Sequence[int]], evaluate: Callable[[list[Trial]], list[float]], n_trials: int, seed: int,
             rounds: int = 5) -> list[tuple[Trial, float]]:
    """Trials and losses in the order they were made; ``evaluate`` gets a round."""
    rng = random.Random(seed)
    size = max(1, -(-n_trials // rounds))
    tried: dict[Trial, float] = {}
    while len(tried) < n_trials:
        n = min(size, n_trials - len(tried))
        points = propose(spaces, tried, n, rng) if tried else random_draw(spaces, n, rng)
        if not points:
            break
        tried.update(zip(points, evaluate(points), strict=True))
    return list(tried.items())
