"""The byte network by another route: plain responses, and slopes by finite differences."""

import numpy as np
import pyarrow as pa

from loomtrace.llm import kernels as K
from loomtrace.llm import langid
from tests.llm.samples import awkward


def network():
    made = langid.Network(["de", "en", "fr"], seed=5)
    made.bias[:] = [0.1, -0.2, 0.3]
    return made


def plain(net, window):
    """Softmax of one window, position by position."""
    pooled = []
    for bank in net.banks:
        w = len(bank)
        scores = [sum(bank[j, window[at + j]] for j in range(w)) for at in range(len(window) - w + 1)]
        pooled.append(np.max(scores, axis=0))
    odds = np.maximum(np.concatenate(pooled), 0) @ net.dense + net.bias
    e = np.exp(odds - odds.max())
    return e / e.sum()


def test_windows_of_awkward_rows(spark):
    texts = [r[0] for r in awkward(spark).select("text").collect()]
    data, offsets = K.text_buffer(pa.array(texts, pa.string()))
    windows, rows = langid.windows_of(data, offsets)
    net = network()
    pick = np.unique(np.linspace(0, len(windows) - 1, 40).astype(int))
    got = langid.probabilities(net, net.tables(), windows[pick])
    assert np.allclose(got, [plain(net, w) for w in windows[pick]], atol=1e-4)
    responses = net.responses(windows[pick])
    pooled = np.concatenate([r.max(axis=1) for r in responses], axis=1)
    assert np.allclose(got, langid.softmax(np.maximum(pooled, 0) @ net.dense + net.bias), atol=1e-4)
    # every byte of every text is in a window of its row
    for k, text in enumerate(texts):
        raw = bytes(K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]) if text else b""
        own = windows[rows == k]
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        whole = b"".join(bytes(w[:step]) for w in own[:-1]) + (bytes(own[-1]) if len(own) else b"")
        assert whole[: len(raw)] == raw and not any(whole[len(raw) :])


def test_first_step_goes_against_the_slope(monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 1)
    rng = np.random.default_rng(2)
    windows, labels = rng.integers(97, 105, (12, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 12)
    start, trained = network(), network()
    trained.train(windows, labels)

    def loss(net):
        p = langid.softmax(np.maximum(np.concatenate([r.max(axis=1) for r in net.responses(windows)], axis=1), 0) @ net.dense + net.bias)
        return -np.mean(np.log(p[np.arange(len(labels)), labels]))

    checked = 0
    for name in ("dense", "bias"):
        for at in np.ndindex(getattr(start, name).shape):
            slopes = []
            for sign in (1, -1):
                other = network()
                getattr(other, name)[at] += sign * 1e-2
                slopes.append(loss(other))
            slope = (slopes[0] - slopes[1]) / 2e-2
            moved = getattr(trained, name)[at] - getattr(start, name)[at]
            if abs(slope) > 1e-3:
                checked += 1
                assert moved * slope < 0
    assert checked > 20
