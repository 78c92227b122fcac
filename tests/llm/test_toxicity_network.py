"""The network against plain loops: forward pass, gradients, windows; and a fit without rows."""

import math

import numpy as np

from reelbase.llm import toxicity as T


def small_case(seed=3):
    rng = np.random.default_rng(seed)
    m = {k: x.astype(np.float64) + rng.normal(0, 0.1, x.shape) for k, x in T.new_model(rng).items()}
    size = np.array([T.WINDOW, 5, 1, 0])
    inputs = rng.normal(0, 1, (len(size), T.WINDOW, T.FEATURES))
    for i, n in enumerate(size):
        inputs[i, n:] = 0
    return m, inputs, size, np.array([1.0, 0.0, 1.0, 0.0])


def plain_logit(m, inputs, size):
    """One window, one step and one unit at a time."""

    def sig(x):
        return 1 / (1 + math.exp(-x))

    h_size, hidden = T.HIDDEN, [[0.0] * (2 * T.HIDDEN) for _ in range(T.WINDOW)]
    for d, order, off in (("f", range(T.WINDOW), 0), ("b", range(T.WINDOW - 1, -1, -1), h_size)):
        W, U, b, k = (m[x + d] for x in "WUbk")
        h = [0.0] * h_size
        for t in order:
            x = [sum(inputs[t][i] * W[i][j] for i in range(T.FEATURES)) + b[j] for j in range(3 * h_size)]
            g = [sum(h[i] * U[i][j] for i in range(h_size)) for j in range(3 * h_size)]
            new = []
            for j in range(h_size):
                r, z = sig(x[j] + g[j]), sig(x[h_size + j] + g[h_size + j])
                c = math.tanh(x[2 * h_size + j] + r * (g[2 * h_size + j] + k[j]))
                new.append((1 - z) * c + z * h[j])
            h = new
            hidden[t][off : off + h_size] = h
    read = max(size, 1)
    e = [math.exp(sum(a * b for a, b in zip(hidden[t], m["v"], strict=True))) for t in range(read)]
    pooled = [sum(e[t] * hidden[t][j] for t in range(read)) / sum(e) for j in range(2 * h_size)]
    return sum(a * b for a, b in zip(pooled, m["u"], strict=True)) + m["c"][0]


def logits(m, inputs, size):
    proj = {d: inputs @ m[f"W{d}"] + m[f"b{d}"] for d in "fb"}
    return T.forward(m, lambda t: proj["f"][:, t], lambda t: proj["b"][:, t], size)[0]


def test_forward_equals_plain_loops():
    m, inputs, size, _ = small_case()
    assert np.allclose(logits(m, inputs, size), [plain_logit(m, x, n) for x, n in zip(inputs, size, strict=True)], atol=1e-4)


def test_gradients_equal_finite_differences():
    m, inputs, size, label = small_case()
    got, rng = T.gradients(m, inputs, size, label), np.random.default_rng(1)

    def loss():
        p = [1 / (1 + math.exp(-plain_logit(m, x, n))) for x, n in zip(inputs, size, strict=True)]
        return -np.mean([math.log(q if y else 1 - q) for q, y in zip(p, label, strict=True)])

    for name, values in m.items():
        for _ in range(3):
            at = tuple(int(rng.integers(n)) for n in values.shape)
            was = values[at]
            values[at] = was + 1e-5
            up = loss()
            values[at] = was - 1e-5
            down = loss()
            values[at] = was
            assert abs((up - down) / 2e-5 - got[name][at]) < 1e-4, (name, at)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 31, 32, 33, 48, 49, 1000])
    start, size, first = T.windows(counts)
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    last = np.concatenate((first[1:], [len(start)]))
    for i, n in enumerate(counts):
        runs = [(int(start[k] - base[i]), int(size[k])) for k in range(first[i], last[i])]
        assert {w for a, k in runs for w in range(a, a + k)} == set(range(n))
        assert all(b[0] - a[0] == T.STRIDE for a, b in zip(runs, runs[1:]))


def test_scores_do_not_depend_on_what_else_is_scored():
    texts = [b"", b"bad thing", b"the good thing " * 90, b"x" * 100_000] * 3
    model = T.fit([b"bad thing here", b"the good thing"] * 20, np.array([1, 0] * 20))
    together = T.score_texts(model, texts)
    assert np.allclose(together, [T.score_texts(model, [t])[0] for t in texts], atol=1e-5)


def test_one_class_or_no_rows():
    for labels, side in (([], 0), ([0, 0], 0), ([1, 1], 1)):
        p = T.score_texts(T.fit([b"some words", b"others"][: len(labels)], np.array(labels)), [b"", b"some words"])
        assert p[0] == p[1] and (p[0] >= 0.5) == bool(side)
