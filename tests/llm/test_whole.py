"""Scores that depend on their text alone, and a packing search that tries every group."""

import numpy as np

from lodestar.llm import packing, quality_cnn


def test_score_alone_and_in_a_batch():
    r = np.random.default_rng(3)
    m = quality_cnn.ByteCNN()
    m.p["left"], m.p["emb"] = m.p["left"] * 0.1, m.p["emb"] * 4
    m.p["emb"][0] = 0
    m.doc = np.array([1.0, 0.5, 0.5, -1, 0.1])
    texts = [b"", *(r.integers(32, 127, n).astype(np.uint8).tobytes() for n in (1, 124, 125, 252, 300, 600_000, 5)), b""]
    batch = m.features(texts)
    for i, t in enumerate(texts):
        assert np.allclose(batch[i], m.features([t])[0], atol=1e-4), i
    assert np.allclose(m.features([b""])[0, 0], m.logits(np.zeros((1, quality_cnn.FILTERS), np.float32))[0], atol=1e-5)
    n = quality_cnn.HALF * 4096  # a chunk over the edge of a block, scored in a long text and alone
    long = r.integers(32, 127, n + 1000).astype(np.uint8).tobytes()
    tail = m.chunk_logits([long[n - 4 * quality_cnn.HALF :]])[0]
    assert np.allclose(m.chunk_logits([long])[0][4092:], tail, atol=1e-4)


def test_plain_forward_pass_and_gradient():
    """Scores by loops over strides, and gradients by differences."""
    m = quality_cnn.ByteCNN()
    m.doc = np.array([1.0, 0.5, 0.5, -1, 0.1])
    p, half = m.p, quality_cnn.HALF
    text = np.random.default_rng(5).integers(32, 127, 500).astype(np.uint8).tobytes()
    n = max(2, -(-(len(text) + 4) // half))
    data = text.ljust(n * half, b"\0")
    strides = [np.concatenate([p["emb"][b] for b in data[i : i + 4]]) for i in range(0, len(data), 4)]
    out = [s @ p["left"] + (strides[i + 1] @ p["right"] if i + 1 < len(strides) else 0) for i, s in enumerate(strides)]
    logits = []
    for c in range(n - 1):
        top = np.max(out[c * 32 : (c + 2) * 32], axis=0)
        h = np.maximum(np.maximum(top + p["cb"], 0) @ p["w1"] + p["b1"], 0)
        logits.append(float((h @ p["w2"] + p["b2"])[0]))
    want = [np.mean(logits), max(logits), min(logits), np.mean(np.array(logits) < 0), 1]
    assert np.allclose(m.features([text])[0], want, atol=1e-4)
    r = np.random.default_rng(9)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y, weight = r.integers(1, 256, (7, 2 * half)).astype(np.uint8), np.array([1, 0, 1, 0, 0, 1, 1.0]), r.random(7) + 0.5

    def loss():
        e = m.p["emb"][x].reshape(7, 64, 32)
        c = e @ m.p["left"]
        c[:, :-1] += e[:, 1:] @ m.p["right"]
        z = m.logits(c.max(axis=1))
        return (weight * (np.logaddexp(0, z) - y * z)).mean()

    grads = m._step(x, y, weight)
    for k in m.p:
        for _ in range(3):
            at = tuple(int(r.integers(1 if k == "emb" and i == 0 else 0, s)) for i, s in enumerate(m.p[k].shape))
            m.p[k][at] += 1e-6
            up = loss()
            m.p[k][at] -= 2e-6
            assert abs((up - loss()) / 2e-6 - grads[k][at]) < 1e-4, k
            m.p[k][at] += 1e-6


def test_search_tries_every_group():
    """250 stuck bins with one piece each stand before three that can empty a fourth."""
    bins = packing.Bins(2048)
    for n in range(1025, 1275):
        bins.add((n,), 1)
    bins.add((1400,), 3)
    bins.add((640, 640, 640), 1)
    pieces = lambda: sorted(x for c, n in bins.groups() for x in c * n)
    before = pieces()
    assert packing.local_search(bins).count() == 253 and pieces() == before
