"""Alignment of two tokenizations of the same text, and how often their ids are linked over a corpus.

Each text is cut into groups at the byte offsets where a token of the first (A) and one of the second (B) tokenizer both end. The
groups are found by *diagonal run skipping*: while the end of token i of A is that of token i + shift of B, stretches of both arrays of ends are compared at
this shift, each twice as long as the one before, and a stretch that differs is halved until the run's end is found; all of a run are one-to-one groups.
What breaks a run is resolved token by token up to the next common end, which gives the new shift and the links of that group.

A text is read by its words: before a space that follows no white space both tokenizers start a new token whatever stands around, so words encode on their own,
each distinct one once while a task's bounded memo holds it, and a long text goes through in stretches.

A's words are merged by the rank of the merged string alone, which gives the ids of the merge rules: only strings are ranked that the rules make one token (proven
beforehand, as for token counts). Where two neighbours x, y make up such a string z, no token ever went over its ends, so what happened inside is what happens to z by itself;
when no lower rank is left, there stand the two parts that the rules merge to z, so x, y are these. A string that the rules do not make one token never comes out of
them: its last step would have been the same by itself.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import cut, small_batches
from reelbase.llm.sentencepiece_codec import BYTE, MARK, NORMAL, USER, id_lists
from reelbase.llm.token_counts import PATTERN, byte_letters, merged

ODD = re.compile(r"  |[^\S ] ")
WORD_START = re.compile(r"(?<=\S)(?= )")
DIGEST = "row long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
ALIGNED = "id {id}, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


def words(text: str) -> list[str]:
    """The words of space + ``text``, each without its first space. Words start at the spaces that follow no white space."""
    marked = " " + text
    return text.split(" ") if not ODD.search(marked) else [w[1:] for w in WORD_START.split(marked)]


def runs(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Aligns two rising lists of ends with the same last one. Returns, each as one flat list, the one-to-one runs (first of A, first of B, length), the
    other groups (end in A, end in B), and the links of those groups (token of A, token of B)."""
    straight, groups, links = [], [], []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:  # a run at the shift j - i
            start, shift = i, j - i
            i += 1
            if i < n and a[i] == b[i + shift]:
                i += 1
                size = 2
                while (there := a[i : i + size]) and there == b[i + shift : i + shift + size]:
                    i += len(there)
                    size *= 2
                size //= 2
                while size:  # the run ends inside the stretch that differs: only shorter ones are tried
                    if (there := a[i : i + size]) and there == b[i + shift : i + shift + size]:
                        i += len(there)
                    size //= 2
            straight += start, start + shift, i - start
            j = i + shift
        else:  # an irregular group, up to the next common end
            while x != y:
                links += i, j
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            links += i, j
            i += 1
            j += 1
            groups += i, j
    return straight, groups, links


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 .. for each of several stretches of so many, end to end."""
    total = int(size.sum())
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)


class Pool:
    """Token ids of numbered words, end to end."""

    def __init__(self):
        self.ids, self.first, self.size = array("i"), array("q"), array("q")

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Ids of new words end to end, and how many each has."""
        self.first.frombytes((len(self.ids) + np.cumsum(size) - size).astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.int32).tobytes())

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words end to end, and how many each word has."""
        size = np.frombuffer(self.size, np.int64)[numbers]
        return np.frombuffer(self.ids, np.int32)[spread(np.frombuffer(self.first, np.int64)[numbers], size)], size


class Piece:
    """A stretch of the words of several texts, aligned. ``texts``: which text each part is of; part k has the tokens ``a_at[k]:a_at[k + 1]`` of A and ``b_at[k]:b_at[k + 1]`` of B.
    ``a_last``, ``b_last``: whether a token is the last of its group. ``links``: tokens of A and of B that overlap."""

    def __init__(self, texts, a_ids, b_ids, a_at, b_at, a_last, b_last, links):
        self.texts, self.a_ids, self.b_ids, self.a_at, self.b_at, self.a_last, self.b_last, self.links = texts, a_ids, b_ids, a_at, b_at, a_last, b_last, links


def load(a_path: str, b_path: str) -> dict:
    """What the vocabulary files give, for tasks: A's ranked strings and its bytes by id, B's bytes by id, the id of a lone mark and the path of B's file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(a_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    vocab, by_rank = model["vocab"], {m: r for r, m in enumerate(merges)}
    made = [vocab[x + y] for x, y in merges]
    if made != sorted(set(made)) or any(i >= made[0] for t, i in vocab.items() if len(t) == 1):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    back = {c: i for i, c in enumerate(byte_letters())}
    a_bytes = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        a_bytes[i] = bytes(back[c] for c in token)
    m = proto.ModelProto()
    with open(b_path, "rb") as f:
        m.ParseFromString(f.read())
    if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces if p.type in (NORMAL, USER)):
        raise ValueError("a piece goes over the start of a word: this vocabulary does not encode words on their own")
    b_bytes = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() for p in m.pieces]
    ranks = {a_bytes[i]: i for token, i in vocab.items() if len(merged(token, by_rank)) == 1}
    return {"ranks": ranks, "a_bytes": a_bytes, "b_bytes": b_bytes, "mark": next(i for i, p in enumerate(m.pieces) if p.piece == MARK), "b_path": b_path}


class Aligner:
    """``memo_chars`` bounds the remembered words. ``stretch`` is about how many characters are aligned at once."""

    def __init__(self, spec: dict, memo_chars: int = 8 << 20, stretch: int = 1 << 20):
        import sentencepiece
        import tiktoken

        self.memo_chars, self.stretch = memo_chars, stretch
        self.a = tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=spec["ranks"], special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=spec["b_path"])
        self.a_bytes, self.b_bytes, self.mark = spec["a_bytes"], spec["b_bytes"], spec["mark"]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # at 2 * id an id of A as it is written, at 2 * id + 1 the last one of its group; and of B
        self.shown = [np.array([f"{i}{c}" for i in range(len(x)) for c in cs], object) for x, cs in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))]
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.used, self.a_pool, self.b_pool, self.good = 0, Pool(), Pool(), array("b")

    def learn(self, new: list[str]) -> None:
        """Encodes new words: those of A joined, some hundred at a time, as a word's tokens do not depend on its neighbours."""
        joined = [" " + " ".join(new[k : k + 200]) for k in range(0, len(new), 200)]
        text = "".join(joined).encode()
        a = np.fromiter(chain.from_iterable(map(self.a.encode_ordinary, joined)), np.int64)
        ids = self.b.encode(new, num_threads=1)
        ids = [x if w else [self.mark] for x, w in zip(ids, new, strict=True)]  # an empty word is a space at the end of a text
        b, b_size = np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))
        wanted = np.cumsum([len(w.encode()) + 1 for w in new])
        ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])[np.cumsum(b_size) - 1]
        to = np.searchsorted(ends, wanted) + 1
        good = np.ones(len(new), np.int8)
        if to[-1] != len(a) or (ends[to - 1] != wanted).any() or (b_ends != wanted).any() or any(b"".join(map(of.__getitem__, x.tolist())) != text for of, x in ((self.a_bytes, a), (self.b_bytes, b))):
            own = [self.a.encode_ordinary(" " + w) for w in new]  # some word does not come back from its tokens: each by itself
            good[:] = [all(b"".join(map(of.__getitem__, x)) == f" {w}".encode() for of, x in ((self.a_bytes, own[k]), (self.b_bytes, ids[k]))) for k, w in enumerate(new)]
            a, to = np.fromiter(chain.from_iterable(own), np.int64), np.cumsum(list(map(len, own)))
        self.numbers.update(zip(new, range(len(self.good), len(self.good) + len(new)), strict=True))
        self.good.frombytes(good.tobytes())
        self.a_pool.add(a, np.diff(to, prepend=0))
        self.b_pool.add(b, b_size)
        self.used += sum(map(len, new)) + 8 * len(new)

    def pieces(self, texts: list[str]) -> Iterator[Piece | int]:
        """The aligned parts of ``texts``, in order. A text that does not come back from its tokens is given as its number, maybe after some of its parts. Empty texts
        are left out."""
        waiting, size = [], 0
        for t, text in enumerate(texts):
            if not text:
                continue
            own, lo = words(text), 0
            while lo < len(own):
                hi, room = lo, self.stretch - size
                if len(text) <= room:
                    hi, room = len(own), room - len(text)
                else:
                    while hi < len(own) and (room > 0 or hi == lo):
                        room -= len(own[hi]) + 1
                        hi += 1
                waiting.append((t, own[lo:hi]))
                lo, size = hi, self.stretch - room
                if size >= self.stretch:
                    yield from self.aligned(waiting)
                    waiting, size = [], 0
        yield from self.aligned(waiting)

    def aligned(self, parts: list[tuple[int, list[str]]]) -> Iterator[Piece | int]:
        if not parts:
            return
        if self.used > self.memo_chars:
            self.forget()
        new = [w for w in {w for _, ws in parts for w in ws} if w not in self.numbers]
        for k in range(0, len(new), 20_000):
            self.learn(new[k : k + 20_000])
        number = self.numbers.__getitem__
        every = np.array(list(map(number, chain.from_iterable(ws for _, ws in parts))), np.int64)
        numbered = np.split(every, np.cumsum([len(ws) for _, ws in parts])[:-1])
        good = np.frombuffer(self.good, np.int8).astype(bool)
        keep = [bool(good[x].all()) for x in numbered]
        yield from (t for (t, _), k in zip(parts, keep, strict=True) if not k)
        texts = [t for (t, _), k in zip(parts, keep, strict=True) if k]
        if not texts:
            return
        numbered = [x for x, k in zip(numbered, keep, strict=True) if k]
        at = np.cumsum([0, *map(len, numbered)])
        every = np.concatenate(numbered)
        (a, a_size), (b, b_size) = self.a_pool.of(every), self.b_pool.of(every)
        a_at, b_at = (np.concatenate(([0], np.cumsum(s)))[at] for s in (a_size, b_size))
        straight, groups, links = runs(np.cumsum(self.a_len[a]).tolist(), np.cumsum(self.b_len[b]).tolist())
        straight, groups, links = (np.array(x, np.int64).reshape(-1, w) for x, w in ((straight, 3), (groups, 2), (links, 2)))
        one = np.stack([spread(straight[:, k], straight[:, 2]) for k in (0, 1)], 1)
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[one[:, 0]] = a_last[groups[:, 0] - 1] = True
        b_last[one[:, 1]] = b_last[groups[:, 1] - 1] = True
        yield Piece(texts, a, b, a_at, b_at, a_last, b_last, np.concatenate((one, links)))

    def written(self, p: Piece) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all groups with what follows each, in the order of the digest, and where each part starts among them."""
        a_end, b_end = np.flatnonzero(p.a_last) + 1, np.flatnonzero(p.b_last) + 1
        out = np.empty(len(p.a_ids) + len(p.b_ids), object)
        before = np.concatenate(([0], b_end))[np.cumsum(p.a_last) - p.a_last]
        out[np.arange(len(p.a_ids)) + before] = self.shown[0][2 * p.a_ids + p.a_last]
        after = a_end[np.cumsum(p.b_last) - p.b_last]
        out[np.arange(len(p.b_ids)) + after] = self.shown[1][2 * p.b_ids + p.b_last]
        return out, p.a_at + p.b_at


class Digest:
    """What the digest gathers of one text over its parts."""

    def __init__(self):
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha, self.pairs, self.times, self.good = None, np.empty(0, np.int64), np.empty(0, np.int64), True

    def add(self, shown: str, n_a: int, n_b: int, n_groups: int, pairs: np.ndarray, times: np.ndarray) -> None:
        if self.sha is None:
            self.sha = sha256()
        else:
            self.sha.update(b";")
        self.sha.update(shown[:-1].encode())
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + int(times.sum())
        if len(self.pairs):
            both, place = np.unique(np.concatenate((self.pairs, pairs)), return_inverse=True)
            self.pairs, self.times = both, np.bincount(place, np.concatenate((self.times, times))).astype(np.int64)
        else:
            self.pairs, self.times = pairs, times


def digests(aligner: Aligner, texts: list[str]) -> list[Digest]:
    out = [Digest() for _ in texts]
    for p in aligner.pieces(texts):
        if isinstance(p, int):
            out[p].good = False
            continue
        shown, at = aligner.written(p)
        part = np.repeat(np.arange(len(p.texts)), np.diff(p.a_at))
        key = (part[p.links[:, 0]] << 36) + (p.a_ids[p.links[:, 0]].astype(np.int64) << 18) + p.b_ids[p.links[:, 1]]
        key, times = np.unique(key, return_counts=True)
        bounds = np.searchsorted(key, np.arange(len(p.texts) + 1) << 36)
        ends = np.concatenate(([0], np.cumsum(p.a_last)))[p.a_at]
        for k, t in enumerate(p.texts):
            lo, hi = bounds[k], bounds[k + 1]
            out[t].add("".join(shown[at[k] : at[k + 1]].tolist()), int(p.a_at[k + 1] - p.a_at[k]), int(p.b_at[k + 1] - p.b_at[k]), int(ends[k + 1] - ends[k]), key[lo:hi] & ((1 << 36) - 1), times[lo:hi])
    return [d if d.good else Digest() for d in out]


_ALIGNERS: dict[str, Aligner] = {}


def aligner(name: str, sent) -> Aligner:
    """The aligner of a Python worker, which keeps its bounded memo from task to task."""
    if name not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[name] = Aligner(sent.value)
    return _ALIGNERS[name]


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``a_ids``, ``b_ids`` (the tokens of space + text) and ``a_ends``, ``b_ends`` (for each group, how many tokens of A and of B end with it or before).

    Texts that are null or empty, or that do not come back byte by byte from their tokens (such as those with U+2581), have empty lists. Repeated rows are each
    aligned; other columns are left out. No shuffle.
    """
    small_batches(docs.sparkSession)
    name, sent = f"{a_path}, {b_path}", docs.sparkSession.sparkContext.broadcast(load(a_path, b_path))
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        al = aligner(name, sent)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [[[], [], [], []] for _ in texts]
            bad = set()
            for p in al.pieces(texts):
                if isinstance(p, int):
                    bad.add(p)
                    continue
                for k, t in enumerate(p.texts):
                    x, y = slice(p.a_at[k], p.a_at[k + 1]), slice(p.b_at[k], p.b_at[k + 1])
                    before = [sum(map(len, o)) for o in out[t][:2]]
                    for o, new in zip(out[t], (p.a_ids[x], p.b_ids[y], np.flatnonzero(p.a_last[x]) + 1 + before[0], np.flatnonzero(p.b_last[y]) + 1 + before[1]), strict=True):
                        o.append(new.astype(np.int32))
            lists = [[np.concatenate([np.empty(0, np.int32), *(o[c] if t not in bad else [])]) for t, o in enumerate(out)] for c in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(id_lists, lists)], ["id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return chosen.mapInArrow(run, ALIGNED.format(id=chosen.schema["id"].dataType.simpleString())).withColumnRenamed("id", id_col)


def linked(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, written once: ``row`` (a number of its own), ``id``, the counts and the hash of its groups, and its distinct linked id pairs (``a``, ``b``) with the
    number of their links (``times``)."""
    small_batches(docs.sparkSession)
    name, sent = f"{a_path}, {b_path}", docs.sparkSession.sparkContext.broadcast(load(a_path, b_path))
    chosen = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = DIGEST.format(id=chosen.schema["id"].dataType.simpleString())

    def run(batches):
        al = aligner(name, sent)
        for batch in batches:
            got = digests(al, batch.column(2).to_pylist())
            counts = [pa.array([getattr(d, n) for d in got], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
            lists = [id_lists([x.astype(np.int32) for x in xs]) for xs in ([d.pairs >> 18 for d in got], [d.pairs & ((1 << 18) - 1) for d in got], [d.times for d in got])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *counts, pa.array([d.sha.hexdigest() if d.sha else "" for d in got]), *lists], [c.split()[0] for c in schema.split(", ")])

    return cut(chosen.mapInArrow(run, schema), "alignment")


def id_pairs(links: DataFrame) -> DataFrame:
    """Of all id pairs that ``linked`` found: ``a``, ``b``, ``documents`` (how many hold the pair) and ``best`` (no pair of that id of A is in more), written once. The pairs are
    counted where they are read before they move, and the highest counts are as many as A's vocabulary has ids."""
    counted = cut(links.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count("*").alias("documents")), "id-pairs")
    most = counted.groupBy("a").agg(F.max("documents").alias("most"))
    return counted.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def digest(docs: DataFrame, a_path: str, b_path: str, most_sent: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (overlapping occurrences), ``n_best`` (links whose pair is in as many documents of the corpus as any of its A id),
    ``count_sum`` (documents of the pair, over all links) and ``groups_sha256``.

    Texts that are null or empty, or that do not come back byte by byte from their tokens, have zeros and an empty hash. Each row is a document, repeated ids or not;
    a null id is kept. Other columns are left out. Each text is tokenized once. The pairs that most documents hold, ``most_sent`` at most, are sent to all
    tasks (17 bytes a pair), so the hot ones never move; links of the rarer ones meet their counts in a shuffle, none of them being frequent.
    """
    spark = docs.sparkSession
    links = linked(docs, a_path, b_path, id_col, text_col)
    pairs = cut(id_pairs(links), "id-pairs-best")
    level = F.floor(F.log2("documents")).cast("int")
    least, total = 63, 0
    for r in pairs.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 63 rows
        total += r["count"]
        if total > most_sent:
            break
        least = r["level"]
    hot = pairs.where(level >= least).select(((F.col("a").cast("long") * (1 << 18)) + F.col("b")).alias("key"), "documents", "best").toArrow().sort_by("key")
    sent = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("key", "documents", "best")))
    names = ["row", "n_best", "count_sum", "a", "b", "times"]

    def run(batches):
        keys, documents, best = sent.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            at = columns["a"].offsets.to_numpy()
            a, b, times = (columns[c].flatten().to_numpy() for c in ("a", "b", "times"))
            key = (a.astype(np.int64) << 18) + b
            at = at - at[0]
            place = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            found = keys[place] == key if len(keys) else np.zeros(len(key), bool)
            place = place[found]
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            totals = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            for total, add in zip(totals, (np.where(best[place], times[found], 0), documents[place] * times[found]) if len(keys) else (), strict=False):
                np.add.at(total, row[found], add)
            left = np.concatenate(([0], np.cumsum(np.bincount(row[~found], minlength=batch.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~found], pa.int32())) for x in (a, b, times)]
            yield pa.RecordBatch.from_arrays([columns["row"], *map(pa.array, totals), *lists], names)

    looked = cut(links.select("row", "a", "b", "times").mapInArrow(run, "row long, n_best long, count_sum long, a array<int>, b array<int>, times array<int>"), "alignment-looked-up")
    rare = looked.select("row", F.inline(F.arrays_zip("a", "b", "times"))).join(pairs.where(level < least), ["a", "b"])
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best_"), F.sum(F.col("documents") * F.col("times")).alias("sum_"))
    whole = links.drop("a", "b", "times").join(looked.select("row", "n_best", "count_sum"), "row").join(rare, "row", "left")
    added = [(F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x) for x, y in (("n_best", "best_"), ("count_sum", "sum_"))]
    return whole.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *added, "groups_sha256")
