"""SentencePiece encoding and decoding over a trie of distinct marked words.

A piece never crosses from a letter to the space mark, so a text splits into marked words that encode on their own. The distinct
words of a task's batch are sorted, which lays them out as a depth-first walk of their trie: each word keeps the forward states of the prefix it
shares with the word before and computes the rest.

The given vocabulary is a BPE one, for which the best-scoring path of a Viterbi search over piece scores is *not* what the library
returns (it merges pairs by rank). The forward state is therefore not a best score but the last piece of the prefix's own
encoding, which is as well determined by earlier states: it is the piece that ends there, whose predecessor is the state at its start, and which
the merge rules leave apart from that predecessor. One pass forward and one back give the library's ids. For a unigram model the forward state also
holds the best score, as in Viterbi's search.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import map_batches, small_batches

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4
UNIGRAM, BPE = 1, 2


def load(path: str) -> dict:
    """Pieces, scores and kinds of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec, kind = m.normalizer_spec, m.trainer_spec.model_type
    if kind not in (UNIGRAM, BPE) or spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not m.trainer_spec.byte_fallback:
        raise ValueError("this codec is for unigram and BPE models with byte fallback, a leading mark and no normalisation")
    return {"pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "kinds": [p.type for p in m.pieces], "unigram": kind == UNIGRAM}


class Codec:
    """``memo_bytes`` bounds what the encoded words take: of two generations the older one goes when the younger has filled half of it, and words still
    in use move on. ``memo_pairs`` bounds the judged pairs of pieces. Texts go through in stretches of about ``stretch`` characters, so that the new words
    of one are bounded too."""

    def __init__(self, spec: dict, memo_bytes: int = 40 << 20, memo_pairs: int = 250_000, stretch: int = 1 << 20):
        self.most_bytes, self.most_pairs, self.stretch = memo_bytes, memo_pairs, stretch
        self.ids = {p: i for i, (p, k) in enumerate(zip(spec["pieces"], spec["kinds"], strict=True)) if k in (NORMAL, USER)}
        self.scores, self.unigram = spec["scores"], spec["unigram"]
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(spec["pieces"], spec["kinds"], strict=True)) if k == BYTE}
        self.pieces = spec["pieces"]
        # every tail of a piece, with the piece's id where it is a whole one, else -1: the trie of the pieces read backwards, as one flat table
        self.tails: dict[str, int] = {p[k:]: -1 for p in self.ids for k in range(1, len(p))}
        self.tails.update(self.ids)
        self.worst = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0  # a letter without a piece, in a unigram model
        self.apart_memo: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}  # ids as packed 32-bit integers
        self.older: dict[str, bytes] = {}
        self.used = 0
        own = {i: b for b, i in self.byte.items()}
        known = set(self.ids.values())
        self.bytes = [bytes([own[i]]) if i in own else p.replace(MARK, " ").encode() if i in known else b"" for i, p in enumerate(spec["pieces"])]

    def merged(self, text: str) -> list[str]:
        """Merging by the rules: the pair whose piece scores best, the leftmost of equals. Only for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, key: int) -> bool:
        """Whether the rules leave two neighbouring pieces apart: key is (left id + 1) * 2^20 + right id; without a left one: whether the right
        one stays whole."""
        a, b = (key >> 20) - 1, self.pieces[key & 0xFFFFF]
        if len(self.apart_memo) >= self.most_pairs:
            self.apart_memo.clear()
        got = self.apart_memo[key] = self.merged(self.pieces[a] + b) == [self.pieces[a], b] if a >= 0 else self.merged(b) == [b]
        return got

    def encode_words(self, words: set[str]) -> None:
        """Adds the ids of new words to the memo, walking their trie depth-first."""
        if 2 * self.used > self.most_bytes:
            self.older, self.words, self.used = self.words, {}, 0
        new = []
        for word in words.difference(self.words):
            if (own := self.older.get(word)) is None:
                new.append(word)
            else:
                self.words[word] = own
                self.used += 200 + 2 * len(word) + len(own)  # about what the entry takes
        new.sort()
        apart, known, tails, pieces, scores, before = self.apart, self.apart_memo.get, self.tails.get, self.pieces, self.scores, ""
        last: list[int] = [-1]  # last[i]: last piece of the encoding of the first i letters; -1: none, or a letter without a piece
        best: list[float] = [0.0]  # best[i]: score of that encoding, in a unigram model
        for word in new:
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared, len(word)):
                found = -1
                at, ends = end, []  # the pieces that end here and where they start, the shortest first
                while at >= 0 and (piece := tails(word[at : end + 1])) is not None:
                    if piece >= 0:
                        ends.append((piece, at))
                    at -= 1
                if self.unigram:
                    top = None
                    for piece, start in reversed(ends):
                        total = best[start] + scores[piece]
                        if top is None or total > top:
                            top, found = total, piece
                    if (found < 0 or len(pieces[found]) > 1) and word[end] not in self.ids and (top is None or best[end] + self.worst > top):
                        top, found = best[end] + self.worst, -1
                    best.append(top)
                else:
                    for piece, start in reversed(ends):
                        key = (last[start] + 1 << 20) + piece
                        if known(key) or (known(key) is None and apart(key)):
                            found = piece
                            break
                last.append(found)
            out, end = [], len(word)
            while end:
                piece = last[end]
                if piece >= 0:
                    out.append(piece)
                    end -= len(pieces[piece])
                else:  # a letter that no piece has: its bytes
                    end -= 1
                    out += [self.byte[b] for b in reversed(word[end].encode())]
            out.reverse()
            self.words[word] = array("i", out).tobytes()
            self.used += 200 + 2 * len(word) + 4 * len(out)
            before = word

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The marked words of a text, by stretches that end between two words."""
        marked, at = MARK + text.replace(" ", MARK) if text else "", 0
        while at < len(marked):
            cut = at + self.stretch
            while cut < len(marked) and not (marked[cut] == MARK != marked[cut - 1]):
                cut += 1
            yield WORDS.findall(marked, at, cut)
            at = cut

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Short texts share a stretch, so that its words are sorted together."""
        out, waiting, size = [[] for _ in texts], [], 0

        def flush():
            self.encode_words({w for _, ws in waiting for w in ws})
            for i, ws in waiting:
                out[i].append(b"".join(map(self.words.__getitem__, ws)))
            waiting.clear()

        for i, text in enumerate(texts):
            for ws in self.stretches(text):
                waiting.append((i, ws))
                size += sum(map(len, ws))
                if size >= self.stretch:
                    flush()
                    size = 0
        flush()
        return [np.frombuffer(b"".join(x), np.int32) for x in out]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids if isinstance(ids, list) else ids.tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str, sent) -> Codec:
    """The codec of a Python worker, which keeps its bounded memos from task to task."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(sent.value)
    return _CODECS[path]


def id_lists(ids: list[np.ndarray]) -> pa.Array:
    """Lists of ids as an Arrow column, without an object for each id."""
    ends = np.cumsum([0, *map(len, ids)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``ids``, the library's token ids of the whole text. Null and empty texts have none; repeated rows are each encoded.
    No shuffle; the broadcast is the vocabulary, whose size its file fixes."""
    return _run(docs, model_path, id_col, text_col, lambda c, texts: [id_lists(c.encode(texts))], ["ids array<int>"])


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text``. Bytes that are no UTF-8 read as U+FFFD. A null list is an empty text."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast(load(model_path))
    chosen = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def make():
        c = codec(model_path, sent)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, text string", make).withColumnRenamed("id", id_col)


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_ids``, ``ids_sha256`` (ids in decimal, comma-joined), ``decoded_sha256`` and ``round_trip`` (whether the decoded text
    equals the text; a text that itself has the space mark does not)."""
    from hashlib import sha256

    def run(c: Codec, texts: list[str]):
        ids = c.encode(texts)
        back = [c.decode(x) for x in ids]
        shown = [sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
        return [pa.array(map(len, ids), pa.int64()), pa.array(shown), pa.array([sha256(x.encode()).hexdigest() for x in back]), pa.array([x == y for x, y in zip(back, texts, strict=True)])]

    return _run(docs, model_path, id_col, text_col, run, ["n_ids long", "ids_sha256 string", "decoded_sha256 string", "round_trip boolean"])


def encoded_and_checked(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``ids``, ``n_ids`` and ``round_trip`` (whether the ids decode to the text)."""

    def run(c: Codec, texts: list[str]):
        ids = c.encode(texts)
        return [id_lists(ids), pa.array(map(len, ids), pa.int64()), pa.array([c.decode(x) == t for x, t in zip(ids, texts, strict=True)])]

    return _run(docs, model_path, id_col, text_col, run, ["ids array<int>", "n_ids long", "round_trip boolean"])


def _run(docs: DataFrame, model_path: str, id_col: str, text_col: str, f, schema: list[str]) -> DataFrame:
    """``f`` takes the codec and the texts of a batch and returns the columns of ``schema``. Batches go through in parts of about a million bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(load(model_path))
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["id", *(s.split()[0] for s in schema)]

    def run(batches):
        c = codec(model_path, sent)
        for b in batches:
            size = np.cumsum(pa.compute.binary_length(b.column(1)).to_numpy(zero_copy_only=False)) >> 20
            for part in np.split(np.arange(b.num_rows), np.nonzero(np.diff(size))[0] + 1):
                if len(part):
                    some = b.slice(part[0], len(part))
                    yield pa.RecordBatch.from_arrays([some.column(0), *f(c, some.column(1).to_pylist())], names)

    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, {', '.join(schema)}").withColumnRenamed("id", id_col)
