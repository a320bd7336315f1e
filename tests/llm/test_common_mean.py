"""Embeddings about a large common mean: near pairs meet in a table."""

import numpy as np
import pytest

from sitescribe.llm import embedding_dedup as E


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8])
def test_threshold_pairs_meet_whatever_the_mean(share):
    rng, dims, pairs = np.random.default_rng(3), 64, 2000
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = rng.standard_normal(dims)
    mean /= np.linalg.norm(mean)

    def about(n):
        own = rng.standard_normal((n, dims))
        return np.sqrt(share) * mean + np.sqrt(1 - share) * unit(own - np.outer(own @ mean, mean))

    a = about(pairs)
    if share:  # partners at the threshold that have the same part along the mean
        own, turn = a - np.sqrt(share) * mean, about(pairs) - np.sqrt(share) * mean
    else:
        own, turn = a, about(pairs)
    turn -= own * (np.sum(own * turn, axis=1) / np.sum(own * own, axis=1))[:, None]
    cosine = (0.93 - share) / (1 - share)
    b = np.sqrt(share) * mean + cosine * own + np.sqrt(1 - cosine**2) * np.linalg.norm(own, axis=1, keepdims=True) * unit(turn)
    assert np.allclose(np.sum(a * b, axis=1), 0.93)
    bits, tables = E.tables_for(1_000_000, 0.93)

    class Shared:
        value = E.learn_rotations(about(E.SAMPLE), bits * tables)

    encode = E._encode(Shared, bits, tables)
    code = lambda x: np.stack(encode([v.tobytes() for v in x]))
    assert (code(a) == code(b)).any(axis=1).mean() >= 0.99
