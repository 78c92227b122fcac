"""Token counts of a byte-level BPE vocabulary, with a whole-token shortcut.

Before any text is read, each string of the vocabulary is merged once by the rules; those that end as
one token are *proven*. A pre-token that is proven counts as one without merging. Only the rest is merged,
and each distinct string of it once per task while the task's bounded memo holds it.
"""

from __future__ import annotations

import heapq
import json
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import Memo, map_batches, small_batches

#: The pattern that splits a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 is itself, the others
    follow from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def letters(text: str) -> str:
    table = byte_letters()
    return "".join([table[b] for b in text.encode()])


def merged(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The tokens of one pre-token: the pair of lowest rank merges first, the leftmost of equals.
    Takes n log n steps, so that texts without spaces are no trap."""
    parts: list = list(word)
    n = len(parts)
    if n < 2:
        return parts
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]


def load(path: str) -> dict:
    """Merge ranks, special strings and proven whole tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(spec["model"]["merges"])}
    specials = [t["content"] for t in spec["added_tokens"]]
    back = {c: b for b, c in enumerate(byte_letters())}
    proven = set()
    for token in spec["model"]["vocab"]:
        if all(c in back for c in token) and len(merged(token, ranks)) == 1:
            try:
                proven.add(bytes(back[c] for c in token).decode())
            except UnicodeDecodeError:
                pass  # part of a character: never a pre-token
    return {"ranks": ranks, "specials": specials, "proven": proven}


def counter(spec: dict):
    """A function from text to number of tokens."""
    ranks = spec["ranks"]
    counts = Memo(lambda word: len(merged(letters(word), ranks)), 300_000)
    whole = dict.fromkeys(spec["proven"], 1)
    find = regex.compile(PATTERN).findall
    cut = regex.compile("|".join(regex.escape(s) for s in spec["specials"])).split if spec["specials"] else lambda t: [t]

    def count(text: str) -> int:
        parts = cut(text)
        n = len(parts) - 1
        for part in parts:
            for word in find(part):
                n += 1 if word in whole else counts[word]
        return n

    return count


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and tokens. Special strings of the vocabulary inside a text count as one token.
    Repeated rows are each counted. Other columns are left out, whatever their names. No shuffle: each task reads,
    counts and writes its rows; the broadcast is the vocabulary, whose size is fixed by its file.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(load(tokenizer_path))
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))

    def make():
        count = counter(spec.value)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = map_batches(chosen, f"id {chosen.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long", make)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
