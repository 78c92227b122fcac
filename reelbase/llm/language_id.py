"""Language of a text by a string kernel.

The kernel is a blended spectrum one on presence: for each length from 1 to ``ORDERS`` the share of distinct byte n-grams that two texts have in common
(the size of the intersection over the root of the product of the sizes), averaged over the lengths. Some sampled texts are landmarks (Nystrom); a text is described
by its kernel values with them, times the inverse root of the landmarks' own kernel matrix, and one ridge regression for each language against the rest
maps that to scores. The n-grams are those of most landmarks, a number that a parameter bounds; others count neither as common nor in the sizes. Scoring a
batch is a presence matrix (texts x n-grams) times the landmarks' matrix, times the weights.

Texts are read lower-cased, as UTF-8, with every ASCII byte that is no letter as a space; an n-gram of two spaces in a row is none.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelbase.llm.common import map_batches, parts, small_batches
from reelbase.llm.toxicity import remainder

ORDERS = 5
UNKNOWN = "und"
LETTER = r"\p{L}"
_ASCII = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode().translate(_ASCII) + b" "


def grams(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin at each byte of ``data``, packed with a leading one so that lengths differ, and which of them have no two spaces in a row."""
    size = max(len(data) - n + 1, 0)
    out, good = np.ones(size, np.uint64), np.ones(size, bool)
    for k in range(n):
        byte = data[k : k + size]
        out = (out << np.uint64(8)) | byte
        if k:
            good &= (byte != 32) | (data[k - 1 : k - 1 + size] != 32)
    return out, good


class Index:
    """Numbers of the known n-grams: a hash table that all n-grams of a batch are looked up in at once."""

    def __init__(self, known: np.ndarray):
        self.known = known
        bits = max(10, int(len(known) * 4).bit_length())
        while True:
            self.shift = np.uint64(64 - bits)
            self.cells, self.numbers, self.most = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), 0
            left, at = np.arange(len(known)), self.cell(known)
            while len(left) and self.most < 8:
                free = self.cells[at] == 0
                first = np.zeros(len(left), bool)
                first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
                taken = free & first
                self.cells[at[taken]], self.numbers[at[taken]] = known[left[taken]], left[taken]
                left, at = left[~taken], (at[~taken] + 1) & ((1 << bits) - 1)
                self.most += 1
            if not len(left):
                return
            bits += 1

    def cell(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> self.shift).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code, -1 where it is unknown."""
        at = self.cell(codes)
        out = np.where(self.cells[at] == codes, self.numbers[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.cells[at] != 0))
        for k in range(1, self.most):
            if not len(open_):
                break
            there = (at[open_] + k) & (len(self.cells) - 1)
            hit = self.cells[there] == codes[open_]
            out[open_[hit]] = self.numbers[there[hit]]
            open_ = open_[~hit & (self.cells[there] != 0)]
        return out


class Model(NamedTuple):
    """``known``: the landmarks' n-grams, sorted, so that those of one length lie together; ``starts``: where the lengths from 2 on begin. ``landmarks``: their scaled presence, n-grams x landmarks. ``weights``: from kernel values to a
    score for each language. ``sharpness`` turns scores into shares."""

    languages: list[str]
    known: np.ndarray
    starts: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float


def presence(texts: list[bytes], index: Index, stretch: int = 1 << 18) -> np.ndarray:
    """texts x known n-grams: 1 where the text has it. Long texts go through in stretches."""
    out = np.zeros((len(texts), len(index.known)), np.float32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data, owner = np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts), dtype=np.int32), size)
    for lo in range(0, len(data), stretch):
        hi = min(lo + stretch, len(data))
        for n in range(1, ORDERS + 1):
            own = data[lo : hi + n - 1]
            codes, good = grams(own, n)
            at = owner[lo : lo + len(codes)]
            good &= at == owner[lo + n - 1 : lo + n - 1 + len(codes)]
            number = index.of(codes[good])
            found = number >= 0
            out[at[good][found], number[found]] = 1
    return out


def scales(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text and length one over the root of how many known n-grams of that length the text has, and over the root of the number of lengths: presence times
    this makes inner products kernel values."""
    return (1 / np.sqrt(np.maximum(np.stack([x.sum(axis=1) for x in np.split(p, starts, axis=1)], 1), 1) * ORDERS)).astype(np.float32)


def kernel_values(texts: list[bytes], model: Model, index: Index) -> np.ndarray:
    """texts x landmarks."""
    p = presence(texts, index)
    scale = scales(p, model.starts)
    return sum((x @ y) * scale[:, n : n + 1] for n, (x, y) in enumerate(zip(np.split(p, model.starts, axis=1), np.split(model.landmarks, model.starts), strict=True)))


def fit(texts: list[str], languages: list[str], landmarks: int = 192, piece: int = 120, ridge: float = 1e-3, most_grams: int = 16_000) -> Model:
    """Landmarks are taken from all languages in turn, whole texts and short pieces of them; the n-grams are those of most landmarks, ``most_grams`` at most. Rows are
    weighted so that each language counts the same."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.empty(0, np.uint64), np.zeros(ORDERS - 1, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), 1.0)
    rows, y = [], []
    for k, (t, lang) in enumerate(zip(texts, languages, strict=True)):
        whole = prepared(t)
        rows.append(whole)
        y.append(names.index(lang))
        if len(whole) > 2 * piece:  # a piece from another place of each text, so that short texts are known too
            at = (k * 7919) % (len(whole) - piece)
            rows.append(b" " + whole[at : at + piece] + b" ")
            y.append(y[-1])
    y = np.array(y)
    own = [np.flatnonzero(y == c) for c in range(len(names))]
    chosen = [int(o[k]) for k in range(max(map(len, own))) for o in own if k < len(o)][:landmarks]
    seen: dict[int, int] = {}
    for r in chosen:
        data = np.frombuffer(rows[r], np.uint8)
        for n in range(1, ORDERS + 1):
            codes, good = grams(data, n)
            for c in np.unique(codes[good]).tolist():
                seen[c] = seen.get(c, 0) + 1
    known = np.array(sorted(sorted(seen, key=lambda c: (-seen[c], c))[:most_grams]), np.uint64)
    starts = np.searchsorted(known, np.array([1 << 8 * n for n in range(2, ORDERS + 1)], np.uint64))
    index = Index(known)
    p = presence([rows[r] for r in chosen], index)
    marks = p * np.repeat(scales(p, starts), np.diff(starts, prepend=0, append=len(known)), axis=1)
    model = Model(names, known, starts, np.ascontiguousarray(marks.T), np.zeros((len(chosen), len(names))), 1.0)
    k_mm = (marks @ marks.T).astype(float)
    values, vectors = np.linalg.eigh(k_mm)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    k_nm = np.concatenate([kernel_values(rows[lo : lo + 64], model, index) for lo in range(0, len(rows), 64)]).astype(float)
    phi = np.hstack((k_nm @ root, np.ones((len(rows), 1))))
    weight = 1 / np.bincount(y, minlength=len(names))[y] / len(names)
    target = 2.0 * (y[:, None] == np.arange(len(names))) - 1
    inner = (phi * weight[:, None]).T @ phi
    inner[np.diag_indices(len(inner) - 1)] += ridge
    beta = np.linalg.solve(inner, (phi * weight[:, None]).T @ target)
    scores = phi @ beta
    sharp = min((2.0**k for k in range(-2, 6)), key=lambda s: -float((weight * log_share(scores, s)[np.arange(len(y)), y]).sum()))
    return model._replace(weights=np.vstack((root @ beta[:-1], beta[-1:])), sharpness=sharp)


def log_share(scores: np.ndarray, sharpness: float) -> np.ndarray:
    z = sharpness * scores
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def predict(texts: list[str], model: Model, index: Index, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The best language's number and its share, for each text. A batch is ``rows`` texts, or about a million bytes of them."""
    best, share = [], []
    ready = [prepared(t) for t in texts]
    for lo in range(0, len(ready), rows):
        for a, b in parts(ready[lo : lo + rows]):
            k = kernel_values(ready[lo + a : lo + b], model, index)
            z = log_share(k @ model.weights[:-1] + model.weights[-1], model.sharpness)
            best.append(z.argmax(axis=1))
            share.append(np.exp(z.max(axis=1)))
    return (np.concatenate(best), np.concatenate(share)) if best else (np.empty(0, np.int64), np.empty(0))


def train(docs: DataFrame, rows_per_language: int = 300, languages: int = 200, sample_bytes: int = 20_000, folds: int = 4, out_fold: int = 2, landmarks: int = 192, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most ``rows_per_language`` texts with a letter, of at most ``sample_bytes`` bytes, of each of the ``languages`` most frequent ones, drawn by a hash of id and text among
    the rows with crc32(id) mod ``folds`` other than ``out_fold``. Rows with a null id, text or language are none of them. What comes to the driver is bounded by those
    parameters, and so is the model."""
    text = F.col(text_col)
    good = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (remainder(id_col, folds) != out_fold) & (F.octet_length(text) <= sample_bytes) & text.rlike(LETTER))
    drawn = good.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    top = drawn.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    # of a large language only hashes in a share of their range that holds some four times the wanted rows are looked at, so none gathers in a task
    share = F.shiftrightunsigned("h", 11) / float(1 << 53) < 4.0 * rows_per_language / F.col("count")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    some = drawn.join(F.broadcast(top), "lang").where(share).select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= rows_per_language).select("lang", "h")
    rows = good.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text")).join(F.broadcast(some), ["lang", "h"])
    got = rows.dropDuplicates(["lang", "h", "text"]).toArrow().sort_by([("h", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return fit(got.column("text").to_pylist(), got.column("lang").to_pylist(), landmarks)


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, out_fold: int = 2) -> DataFrame:
    """Per row: id, ``held_out`` (crc32(id) mod ``folds`` is ``out_fold``: not learned from), ``lang_pred`` (a learned language; "und" without a letter, or if none was
    learned) and ``score`` (0 to 1: the share of that language; 0 for "und").

    Null and empty texts are "und". Equal texts get equal results, repeated rows are each judged, a null id is not held out, ties go to the first language by name. Other columns are left
    out. No shuffle; the broadcast is the model, of a size that its parameters bound.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).rlike(LETTER), F.col(text_col)).alias("text"))

    def make():
        m = sent.value
        index = Index(m.known)

        def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            rows = [k for k, t in enumerate(texts) if t is not None and m.languages]
            best, share = predict([texts[k] for k in rows], m, index)
            for k, b, s in zip(rows, best, share, strict=True):
                names[k], scores[k] = m.languages[b], s
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

        return judge

    out = map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, lang_pred string, score double", make)
    return out.select(F.col("id").alias(id_col), F.coalesce(remainder("id", folds) == out_fold, F.lit(False)).alias("held_out"), "lang_pred", "score")
