import datetime as dt
import itertools
import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture
def rng():
    return random.Random(7)


def prose(rng, n):
    """n words, most of them unlikely to repeat elsewhere."""
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def frame(spark, rows, schema, clash=()):
    """rows plus extra columns whose names clash with the operators' own."""
    extra = {c: dt.date(2020, 1, 1) for c in clash}
    full = [(*r, *extra.values()) for r in rows]
    return spark.createDataFrame(full, schema + "".join(f", {c} date" for c in clash))


def groups(links, nodes):
    """Smallest node that each node reaches."""
    low = {n: n for n in nodes}
    for _ in itertools.count():
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if before == low:
            return low
