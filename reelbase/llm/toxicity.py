"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network by what it is (log odds of the word among toxic and other labelled documents) and by its
characters (log odds of its byte n-grams). The network reads windows of words that overlap by half; a document's
score is that of its highest window, and training is by that window too. Fitting takes a bounded sample of labelled rows; scoring
reads every window of every text, inside the tasks that read it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import free_name, map_batches, parts, small_batches
from reelbase.llm.decontam import words

CELLS = 1 << 17  # of each table of log odds
WINDOW, STRIDE, HIDDEN, FEATURES = 32, 16, 8, 6
GRAMS = (3, 4, 5)


def word_cells(vocab: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w) & (CELLS - 1) for w in vocab), np.int64, len(vocab))


def gram_cells(vocab: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of all byte n-grams of each marked word, laid end to end: (cell, valid, first place of each word)."""
    text = np.frombuffer(b"<" + b"><".join(vocab) + b">", np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, vocab), np.int64, len(vocab)) + 2
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    left = np.repeat(first + size, size) - np.arange(len(text))
    cells, valid = [], []
    for n in GRAMS:
        h = np.full(len(text), n, np.uint64)
        for k in range(n):
            h = (h ^ np.concatenate((text[k:], np.zeros(k, np.uint64)))) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        cells.append((h & np.uint64(CELLS - 1)).astype(np.int64))
        valid.append(left >= n)
    return np.stack(cells, 1), np.stack(valid, 1), first


def features(vocab: list[bytes], word_odds: np.ndarray, gram_odds: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A row for each word: log odds of the word, how often it was seen, largest, mean and smallest log odds of its n-grams, length."""
    out = np.zeros((len(vocab), FEATURES), np.float32)
    if not vocab:
        return out
    w = word_cells(vocab)
    cell, valid, first = gram_cells(vocab)
    v = gram_odds[cell]
    out[:, 0], out[:, 1] = word_odds[w], np.log1p(seen[w]) / 4
    out[:, 2] = np.maximum.reduceat(np.where(valid, v, -4).max(axis=1), first)
    out[:, 3] = np.add.reduceat(np.where(valid, v, 0).sum(axis=1), first) / np.maximum(np.add.reduceat(valid.sum(axis=1), first), 1)
    out[:, 4] = np.minimum.reduceat(np.where(valid, v, 4).min(axis=1), first)
    out[:, 5] = np.minimum(np.fromiter(map(len, vocab), np.float32, len(vocab)), 20) / 10
    return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts with so many words, laid end to end: (place of the first word, words in it, first window of each text).
    A text without words has one empty window."""
    n = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(len(text)) - first[text]) * STRIDE
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return base[text] + start, np.minimum(WINDOW, counts[text] - start), first


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_model(rng) -> dict[str, np.ndarray]:
    m = {"v": rng.normal(0, 0.3, 2 * HIDDEN), "u": rng.normal(0, 0.3, 2 * HIDDEN), "c": np.array([-1.0])}
    for d in "fb":
        m |= {f"W{d}": rng.normal(0, 0.4, (FEATURES, 3 * HIDDEN)), f"U{d}": rng.normal(0, 0.25, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN), f"k{d}": np.zeros(HIDDEN)}
        m[f"b{d}"][HIDDEN : 2 * HIDDEN] = -1
    return {k: x.astype(np.float32) for k, x in m.items()}


def step(x, h, U, k):
    """One step of the gated unit; x holds the projected input for reset, update and candidate."""
    g = h @ U
    rz = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
    inner = g[:, 2 * HIDDEN :] + k
    c = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
    return c + z * (h - c), (r, z, c, inner)


def forward(m, xf, xb, size, keep=False):
    """Logits of windows. xf, xb: step -> projected inputs; size: words in each window."""
    n, state = len(size), {}
    hs = np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
    for d, x, order, at in (("f", xf, range(WINDOW), slice(0, HIDDEN)), ("b", xb, range(WINDOW - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
        h = np.zeros((n, HIDDEN), np.float32)
        for t in order:
            before = h
            h, s = step(x(t), h, m[f"U{d}"], m[f"k{d}"])
            hs[t, :, at] = h
            if keep:
                state[d, t] = (before, *s)
    e = hs @ m["v"] + np.where(np.arange(WINDOW)[:, None] < np.maximum(size, 1), 0, -1e9).astype(np.float32)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, hs)
    return pooled @ m["u"] + m["c"][0], (hs, a, pooled, state)


def gradients(m, inputs, size, label):
    """Gradients of the mean log loss. inputs: (windows, WINDOW, FEATURES)."""
    n = len(size)
    proj = {d: inputs @ m[f"W{d}"] + m[f"b{d}"] for d in "fb"}
    logit, (hs, a, pooled, state) = forward(m, lambda t: proj["f"][:, t], lambda t: proj["b"][:, t], size, keep=True)
    d_logit = ((sigmoid(logit) - label) / n).astype(np.float32)
    g = {k: np.zeros_like(x) for k, x in m.items()}
    g["u"], g["c"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
    d_pool = d_logit[:, None] * m["u"]
    d_a = np.einsum("nh,tnh->tn", d_pool, hs)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["v"] = np.einsum("tn,tnh->h", d_e, hs)
    d_hs = a[:, :, None] * d_pool + d_e[:, :, None] * m["v"]
    for d, order, at in (("f", range(WINDOW - 1, -1, -1), slice(0, HIDDEN)), ("b", range(WINDOW), slice(HIDDEN, 2 * HIDDEN))):
        dh = np.zeros((n, HIDDEN), np.float32)
        for t in order:
            before, r, z, c, inner = state[d, t]
            dh = dh + d_hs[t, :, at]
            d_c = dh * (1 - z) * (1 - c * c)
            d_z = dh * (before - c) * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_x = np.concatenate([d_r, d_z, d_c], axis=1)
            d_g = np.concatenate([d_r, d_z, d_c * r], axis=1)
            g[f"W{d}"] += inputs[:, t].T @ d_x
            g[f"b{d}"] += d_x.sum(axis=0)
            g[f"U{d}"] += before.T @ d_g
            g[f"k{d}"] += (d_c * r).sum(axis=0)
            dh = dh * z + d_g @ m[f"U{d}"].T
    return g


def logits(m, table: np.ndarray, ids: np.ndarray, counts: np.ndarray, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows of texts whose words are rows ``ids`` of ``table``, and the first window of each text."""
    start, size, first = windows(counts)
    pf, pb = (table @ m[f"W{d}"] + m[f"b{d}"] for d in "fb")
    pad_f, pad_b = m["bf"], m["bb"]
    pf, pb = np.vstack([pf, pad_f]), np.vstack([pb, pad_b])
    padded = np.concatenate((ids, np.full(WINDOW, len(table), np.int64)))
    out = np.empty(len(start), np.float32)
    for lo in range(0, len(start), chunk):
        s, z = start[lo : lo + chunk], size[lo : lo + chunk]
        at = np.minimum(s + np.arange(WINDOW)[:, None], len(padded) - 1)
        at = np.where(np.arange(WINDOW)[:, None] < z, padded[at], len(table))
        out[lo : lo + chunk] = forward(m, lambda t, at=at: np.take(pf, at[t], axis=0), lambda t, at=at: np.take(pb, at[t], axis=0), z)[0]
    return out, first


def odds(toxic: np.ndarray, other: np.ndarray, share: float, prior: float = 3.0) -> np.ndarray:
    """Log odds against the overall share; cells with few documents stay near 0."""
    return np.clip(np.log((toxic + prior * share) / (other + prior * (1 - share)) * (1 - share) / share), -3, 4).astype(np.float32)


class Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def numbered(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, word numbers of all texts end to end, words in each text."""
    at = Numbers()
    number = at.__getitem__
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        counts[i] = len(w)
        parts.append(np.fromiter(map(number, w), np.int64, len(w)))
    return list(at), np.concatenate(parts) if parts else np.empty(0, np.int64), counts


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    """Tables of log odds and the network's weights. With no row, or one class only, the score is the share of toxic rows throughout.
    The inputs of a training row leave out what the row itself added to the tables."""
    rng, labels = np.random.default_rng(seed), np.asarray(labels, np.float32)
    m = new_model(rng)
    vocab, ids, counts = numbered(texts)
    if not len(labels) or labels.min() == labels.max():
        m["u"][:] = 0
        m["c"][0] = np.float32(4 if len(labels) and labels[0] == 1 else -4)
        zero = np.zeros(CELLS, np.float32)
        return m | {"word_odds": zero, "gram_odds": zero, "seen": zero}
    base = np.concatenate(([0], np.cumsum(counts)))
    wc = word_cells(vocab)
    gc, valid, first = gram_cells(vocab)
    after = np.concatenate((first[1:], [len(gc)]))
    tables = {k: [np.zeros(CELLS), np.zeros(CELLS)] for k in ("word", "gram")}
    for i, y in enumerate(labels.astype(int)):
        own = np.unique(ids[base[i] : base[i + 1]])
        if len(own):
            rows = np.concatenate([np.arange(a, b) for a, b in zip(first[own].tolist(), after[own].tolist(), strict=True)])
            tables["word"][1 - y][np.unique(wc[own])] += 1
            tables["gram"][1 - y][np.unique(gc[rows][valid[rows]])] += 1
    share = float(labels.mean())
    tox = {k: (t[0], t[1]) for k, t in tables.items()}
    seen = (tables["word"][0] + tables["word"][1]).astype(np.float32)
    final = {f"{k}_odds": odds(*tox[k], share) for k in tox} | {"seen": seen}
    # a toxic row is read with one toxic document fewer in each cell, another with one other fewer
    less = [features(vocab, odds(np.maximum(tox["word"][0] - y, 0), np.maximum(tox["word"][1] - (1 - y), 0), share), odds(np.maximum(tox["gram"][0] - y, 0), np.maximum(tox["gram"][1] - (1 - y), 0), share), np.maximum(seen - 1, 0)) for y in (0, 1)]
    table = np.vstack([*less, np.zeros((1, FEATURES), np.float32)])
    own_ids = ids + np.repeat(labels.astype(np.int64), counts) * len(vocab)
    start, size, win = windows(counts)
    last = np.concatenate((win[1:], [len(start)]))
    state = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in m.items()}
    rate, n = 0.02, 0
    padded = np.concatenate((own_ids, np.full(WINDOW, len(table) - 1)))
    strong = np.concatenate((table[own_ids, 0] + table[own_ids, 2], np.zeros(WINDOW, np.float32)))
    steps = np.arange(WINDOW)
    score = np.where(steps < size[:, None], strong[np.minimum(start[:, None] + steps, len(strong) - 1)], -9).max(axis=1)
    for epoch in range(epochs):
        if epoch and epoch % 4 == 0:
            score, _ = logits(m, table, own_ids, counts)
        top = np.array([a + int(np.argmax(score[a:b])) for a, b in zip(win.tolist(), last.tolist(), strict=True)])
        at = np.where(steps < size[top, None], padded[np.minimum(start[top, None] + steps, len(padded) - 1)], len(table) - 1)
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 128):
            pick = order[lo : lo + 128]
            g = gradients(m, table[at[pick]], size[top[pick]], labels[pick])
            n += 1
            for k, x in g.items():
                s1, s2 = state[k]
                s1 += 0.1 * (x - s1)
                s2 += 0.01 * (x * x - s2)
                m[k] -= (rate * (1 - epoch / epochs) + 1e-4) * (s1 / (1 - 0.9**n)) / (np.sqrt(s2 / (1 - 0.99**n)) + 1e-8)
    return m | final


def score_texts(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """The highest window's score of each text. Texts go through by about a million bytes and their words by slices, which bounds the arrays."""
    scores = []
    for lo, hi in parts(texts):
        vocab, ids, counts = numbered(texts[lo:hi])
        slices = [vocab[k : k + 16384] for k in range(0, max(1, len(vocab)), 16384)]
        table = np.vstack([features(v, model["word_odds"], model["gram_odds"], model["seen"]) for v in slices])
        out, first = logits(model, table, ids, counts)
        scores.append(sigmoid(np.maximum.reduceat(out, first).astype(np.float64)))
    return np.concatenate(scores) if scores else np.empty(0)


def remainder(id_col: str, folds: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_bytes: int = 20_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, np.ndarray]:
    """Fit on at most ``sample_rows`` labelled documents of at most ``sample_bytes`` bytes, drawn by a hash of their id among those with
    crc32(id) mod ``folds`` not 0. Null ids, labels and texts are no training rows. The broadcast and what comes to the driver are bounded by those two parameters."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (remainder(id_col, folds) != 0)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    drawn = rows.orderBy(F.xxhash64("id"), "id", "y").limit(2 * sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_col).cast("binary").alias("text")).where(F.octet_length("text") <= sample_bytes)
    got = texts.join(F.broadcast(drawn), "id").orderBy(F.xxhash64("id"), "id", "y").limit(sample_rows).toArrow()
    return fit(got.column("text").to_pylist(), got.column("y").to_numpy())


def toxicity(docs: DataFrame, model: dict[str, np.ndarray], folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out`` (crc32(id) mod ``folds`` is 0: its label was not learned from), ``score`` (0 to 1), ``predicted`` (score >= 0.5).

    Null and empty texts are one empty window and get its score; repeated rows get equal scores; a null id is not held out. Other
    columns are left out. No shuffle; the broadcast is the model, whose size is fixed.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text"))

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(sent.value, b.column(1).to_pylist()))], ["id", "score"])

    out = map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, score double", make)
    return out.select(F.col("id").alias(id_col), F.coalesce(remainder("id", folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """The documents that score below 0.5, with all their columns; each row is judged by its own text, where it is read."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, helper = docs.columns, free_name(docs, "__text")

    def make():
        return lambda b: b.filter(pa.array(score_texts(sent.value, b.column(helper).to_pylist()) < 0.5)).select(names)

    return map_batches(docs.withColumn(helper, F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")), docs.schema, make)
