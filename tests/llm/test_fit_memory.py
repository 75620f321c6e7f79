"""The driver fits the quality rules on one matrix, without copies of it."""

import tracemalloc

import numpy as np

from waymark.llm import quality_rules


def test_fit_copies_nothing():
    rng = np.random.default_rng(3)
    y = np.arange(400) % 2
    packed = [(rng.random(quality_rules.DIMS) * (0.02 + 0.01 * t)).astype(np.float16).tobytes() for t in y]
    x = quality_rules.matrix(packed, np.ones(400, dtype=bool))
    assert x.dtype == np.float32 and (x[7] == np.frombuffer(packed[7], np.float16)).all()
    tracemalloc.start()
    w, b = quality_rules.fit_logistic(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes / 4
    assert ((x @ w + b > 0) == (y == 1)).mean() > 0.9
