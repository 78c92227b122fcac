"""Benchmark decontamination with suffix arrays over the training shards.

Each task takes its documents in shards of bounded size, numbers their words by the benchmark's vocabulary
(0: a word of no benchmark item, which ends every match), sorts the suffixes that are long enough to hold a match
and binary-searches every suffix of the benchmark in them, by its first window of words. Where windows are found, the places of both sides are sorted to
their full length, as one suffix array: next to a place stands the item suffix with which it shares most, so its longest verbatim match and where
that lies follow from a neighbour. Documents with a match go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import cut, free_name, map_batches, small_batches, utf8
from reelbase.llm.common import parts as runs_of

#: Bytes that are not in words become spaces, A-Z are lower-cased.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Vocabulary(dict):
    def __missing__(self, word):
        return 0


class Queries:
    """The benchmark's windows: for each distinct run of ``window`` words (or whole shorter item) its key, its length and
    the items that hold it."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window, self.ids = window, ["null" if i is None else str(i) for i, _ in items]
        self.vocabulary = Vocabulary()
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], np.int64) for _, t in items]
        at: dict[bytes, dict[int, None]] = {}
        suffixes: list[tuple[bytes, int, int]] = []  # the first window of each suffix that holds one, its item and its start there
        for i, t in enumerate(texts):
            m = min(window, len(t))
            for s in range(len(t) - m + 1 if m else 0):
                key = t[s : s + m].astype(">u4").tobytes()
                at.setdefault(key, {})[i] = None
                suffixes.append((key, i, s))
        order = sorted(at)
        number = {k: n for n, k in enumerate(order)}
        self.suffix_key = np.array([number[k] for k, _, _ in suffixes], np.int64)
        self.suffix_item = np.array([i for _, i, _ in suffixes], np.int64)
        self.suffix_start = np.array([s for _, _, s in suffixes], np.int64)
        self.lengths = np.array([len(k) // 4 for k in order], np.int64)
        self.items = [np.fromiter(at[k], np.int64) for k in order]
        self.low = np.array(order, f"S{4 * window}")
        self.high = np.array([k.ljust(4 * window, b"\xff") for k in order], f"S{4 * window}")
        self.shortest = int(self.lengths.min()) if order else 0


def suffix_array(ids: np.ndarray, shortest: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes with at least ``shortest`` known words, sorted by their first ``depth`` words, and those words as
    big-endian keys. A zero ends a suffix."""
    n = len(ids)
    stop = np.minimum.accumulate(np.where(ids == 0, np.arange(n), n)[::-1])[::-1]
    run = stop - np.arange(n)
    places = np.nonzero(run >= shortest)[0]
    if not len(places):
        return places, np.empty(0, f"S{4 * depth}")
    steps = np.arange(depth)
    rows = np.where(steps < run[places, None], ids[np.minimum(places[:, None] + steps, n - 1)], 0).astype(">u4")
    keys = np.ascontiguousarray(rows).view(f"S{4 * depth}").ravel()
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def found(ids: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of every occurrence of every window in a shard."""
    places, keys = suffix_array(ids, q.shortest, q.window)
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low, high = np.searchsorted(keys, q.low, "left"), np.searchsorted(keys, q.high, "right")
    size = high - low
    query = np.repeat(np.arange(len(size)), size)
    return query, places[np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(query))]


def runs(*parts: np.ndarray) -> np.ndarray:
    """For rows sorted by ``parts``, the last of them a place: how many rows from each on follow one another place by place."""
    n = len(parts[-1])
    joined = np.ones(max(n - 1, 0), bool)
    for p in parts[:-1]:
        joined &= p[1:] == p[:-1]
    joined &= parts[-1][1:] == parts[-1][:-1] + 1
    ends = np.append(np.nonzero(~joined)[0], n - 1)
    return ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1


def longest(query: np.ndarray, place: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the hits (query, place) of a shard: the distinct places, the number of words of the longest match that starts there, and a suffix of the benchmark
    (its number) that it is a match with.

    The windows at successive places are letters: two suffixes that share L successive windows share L + window - 1 words. Places and those
    suffixes of the benchmark whose window was hit are ranked together by their first 1, 2, 4 ... letters, which sorts them."""
    # at a place where windows of several lengths begin, the longest one counts
    by = np.lexsort((-q.lengths[query], place))
    query, place = query[by], place[by]
    first = np.append(True, place[1:] != place[:-1])
    query, place = query[first], place[first]
    own = np.nonzero(np.isin(q.suffix_key, query))[0]
    letters = np.concatenate([query, q.suffix_key[own]])
    run = np.concatenate([runs(place), runs(q.suffix_item[own], q.suffix_start[own])])
    n, split, size = len(letters), len(place), min(int(run[: len(place)].max()), int(run[len(place) :].max()))
    levels, step = [np.unique(letters, return_inverse=True)[1].astype(np.int64)], 1
    while step < size:
        after = np.where(run > step, levels[-1][np.minimum(np.arange(n) + step, n - 1)] + 1, 0)
        levels.append(np.unique(levels[-1] * (n + 1) + after, return_inverse=True)[1])
        step *= 2
    order = np.lexsort((np.arange(n) < split, levels[-1]))
    best, match = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for side in (order, order[::-1]):
        # the nearest suffix of the benchmark before each place, in this direction
        theirs = side >= split
        near = np.maximum.accumulate(np.where(theirs, np.arange(n), -1))
        x, y = side[~theirs & (near >= 0)], side[near[~theirs & (near >= 0)]]
        start, other, shared, left = x.copy(), y.copy(), np.zeros(len(x), np.int64), np.minimum(run[x], run[y])
        for k in range(len(levels) - 1, -1, -1):
            more = (left >= 1 << k) & (levels[k][np.minimum(start, n - 1)] == levels[k][np.minimum(other, n - 1)])
            shared += more.astype(np.int64) << k
            left -= more.astype(np.int64) << k
            start += more.astype(np.int64) << k
            other += more.astype(np.int64) << k
        better = shared > best[x]
        best[x[better]], match[x[better]] = shared[better], y[better]
    return place, q.lengths[query] + best[:split] - 1, own[match[:split] - split]


def numbered(texts: list[bytes], q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of a shard (a zero after each text), first place and number of words of each text."""
    get, parts, zero = q.vocabulary.__getitem__, [], np.zeros(1, np.int64)
    counts = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        counts[i] = len(w)
        parts += [np.fromiter(map(get, w), np.int64, len(w)), zero]
    first = np.concatenate(([0], np.cumsum(counts + 1)[:-1]))
    return np.concatenate(parts), first, counts


@dataclass
class Scanned:
    """Per text: number of words, hit intervals (start, end, start, end ...), ids of the items hit, words of the longest match and where it starts (-1
    without one). And the maximal matches of all texts: text, start there, words, item and start there."""

    n_words: list[int]
    spans: list[list[int]]
    items: list[list[str]]
    longest: list[int]
    longest_at: list[int]
    matches: list[tuple[int, int, int, str, int]]


def scan(texts: list[bytes], q: Queries, most: int) -> Scanned:
    out = Scanned([], [[] for _ in texts], [[] for _ in texts], [0] * len(texts), [-1] * len(texts), [])
    for a, b in runs_of(texts, most):
        ids, first, counts = numbered(texts[a:b], q)
        out.n_words += counts.tolist()
        query, place = found(ids, q)
        if not len(query):
            continue
        mark = np.zeros(len(ids) + 1, np.int64)
        np.add.at(mark, place, 1)
        np.add.at(mark, place + q.lengths[query], -1)
        edge = np.diff(np.concatenate(([0], (np.cumsum(mark) > 0).astype(np.int8))))
        starts, ends = np.nonzero(edge > 0)[0], np.nonzero(edge < 0)[0]
        for s, e, d in zip(starts.tolist(), ends.tolist(), (np.searchsorted(first, starts, "right") - 1).tolist(), strict=True):
            out.spans[a + d] += [s - int(first[d]), e - int(first[d])]
        doc = np.searchsorted(first, place, "right") - 1
        pairs = np.unique(np.stack([doc, query]), axis=1)
        hit: dict[int, set[int]] = {}
        for d, k in zip(*pairs.tolist(), strict=True):
            hit.setdefault(d, set()).update(q.items[k].tolist())
        for d, own in hit.items():
            out.items[a + d] = sorted({q.ids[i] for i in own})
        at, length, suffix = longest(query, place, q)
        doc = np.searchsorted(first, at, "right") - 1
        # a match that begins one word after another and ends with it is a part of it
        part = np.append(False, (at[1:] == at[:-1] + 1) & (length[1:] == length[:-1] - 1))
        for d, s, n, i, t in zip(*(x[~part].tolist() for x in (doc, at - first[doc], length, q.suffix_item[suffix], q.suffix_start[suffix])), strict=True):
            out.matches.append((a + d, s, n, q.ids[i], t))
            if n > out.longest[a + d]:
                out.longest[a + d], out.longest_at[a + d] = n, s
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[object, bytes]]]]:
    """How many blocks the benchmark's items fill, by their checked size, and the blocks, which come to the driver one at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), utf8(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = -(-size // block_bytes) or 1
    if n == 1:
        return 1, iter([[tuple(r) for r in items.collect()]])
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return n, ([tuple(r) for r in dealt.where(F.col("block") == k).select("item", "text").collect()] for k in range(n))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = 8 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """Per document: id, ``n_words``, ``spans`` (word intervals start, end, start, end ... that occur in the benchmark, end
    exclusive), ``items`` (ids of the items whose windows occur, as sorted strings), ``longest`` (words of the longest verbatim match that holds a
    window; 0 without) and ``longest_at`` (the word at which the first such match starts; -1 without).

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null, empty and wordless texts
    have no words and no hits; an empty benchmark hits nothing. Repeated documents are each reported; a null item id
    reads as the string "null"; an item id that repeats is listed once. A benchmark of at most ``block_bytes`` (checked) is sent to
    the tasks whole: nothing is shuffled, the documents stay where they are read. A larger one goes in blocks of about that size:
    the texts are written once with a number for each row, there is one pass over them per block, whose hits are written before the next block is fetched,
    and the hits are united per row. So no more than one block is held by the driver or an executor.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, spans array<int>, items array<string>, longest long, longest_at long"
    n_blocks, parts = blocks(benchmark, item_col, text_col, block_bytes)
    if n_blocks > 1:
        schema = f"row long, {schema}"
        chosen = cut(chosen.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")
    keys = chosen.columns[:-1]

    def one(items):
        q = spark.sparkContext.broadcast(Queries(items, window))

        def make():
            own = q.value

            def run(b):
                x = scan(b.column("text").to_pylist(), own, shard_bytes)
                found = [pa.array(x.n_words, pa.int64()), pa.array(x.spans, pa.list_(pa.int32())), pa.array(x.items, pa.list_(pa.string())), pa.array(x.longest, pa.int64()), pa.array(x.longest_at, pa.int64())]
                return pa.RecordBatch.from_arrays([*map(b.column, keys), *found], [*keys, "n_words", "spans", "items", "longest", "longest_at"])

            return run

        return map_batches(chosen, schema, make), q

    if n_blocks == 1:
        return one(next(parts))[0].withColumnRenamed("id", id_col)
    out = None
    for items in parts:
        hits, sent = one(items)
        # the first block reports every row, the others add what they hit
        hits = cut(hits if out is None else hits.where("longest > 0"), "hits")
        sent.destroy()
        out = hits if out is None else out.unionByName(hits)
    return united(out).withColumnRenamed("id", id_col)


def united(parts: DataFrame) -> DataFrame:
    """The hits of several blocks as one row per ``row``; overlapping intervals grow together."""
    pairs = "flatten(collect_list(transform(sequence(0, greatest(size(spans) div 2 - 1, 0)), i -> named_struct('s', get(spans, 2*i), 'e', get(spans, 2*i+1)))))"
    best = F.max_by(F.struct("longest", "longest_at"), F.struct("longest", -F.col("longest_at")))
    out = parts.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.expr(f"array_sort(filter({pairs}, x -> x.s is not null))").alias("p"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        best.alias("best"),
    )
    grown = """aggregate(p, cast(array() as array<int>), (a, x) -> case when size(a) > 0 and get(a, size(a) - 1) >= x.s
      then concat(slice(a, 1, size(a) - 1), array(greatest(get(a, size(a) - 1), x.e))) else concat(a, array(x.s, x.e)) end)"""
    return out.select("id", "n_words", F.expr(grown).alias("spans"), "items", "best.longest", "best.longest_at")


def hit_words(spans: str = "spans"):
    return F.expr(f"cast(aggregate(transform({spans}, (x, i) -> if(i % 2 = 0, -x, x)), 0, (a, x) -> a + x) as long)")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = 8 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """One row per place of a document where a longest verbatim match starts: id, ``doc_start``, ``length`` (both in words), ``item`` and ``item_start``, one
    place of the benchmark that it matches. A match has at least ``window`` words or is a whole shorter item; one that is the tail of the match a word
    before is left out. Nulls as in :func:`contamination`; one block of the benchmark is held at a time, and matches are found in each."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text"))
    schema = f"id {chosen.schema['id'].dataType.simpleString()}, doc_start int, length int, item string, item_start int"
    n_blocks, parts = blocks(benchmark, item_col, text_col, block_bytes)
    out = None
    for items in parts:
        q = spark.sparkContext.broadcast(Queries(items, window))

        def make(q=q):
            own = q.value

            def run(b):
                rows = scan(b.column(1).to_pylist(), own, shard_bytes).matches
                if not rows:
                    return None
                at, start, length, item, item_start = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(item, pa.string()), pa.array(item_start, pa.int32())], ["id", "doc_start", "length", "item", "item_start"])

            return run

        found = map_batches(chosen, schema, make)
        if n_blocks > 1:
            found = cut(found, "matches")
            q.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", block_bytes: int = 8 << 20, shard_bytes: int = 4 << 20) -> DataFrame:
    """The documents without a verbatim match of ``window`` words (or of a whole shorter item), with all their columns; each row is judged by its own text,
    where it is read. Documents without words stay. Beyond one block of the benchmark what is left is written after each block."""
    spark = docs.sparkSession
    small_batches(spark)
    helper = free_name(docs, "__words_of")
    out = docs.withColumn(helper, utf8(text_col))
    n_blocks, parts = blocks(benchmark, item_col, text_col, block_bytes)
    for items in parts:
        sent = spark.sparkContext.broadcast(Queries(items, window))

        def make(sent=sent):
            def run(b):
                return b.filter(pa.array([not n for n in scan(b.column(helper).to_pylist(), sent.value, shard_bytes).longest], pa.bool_()))

            return run

        out = map_batches(out, out.schema, make)
        if n_blocks > 1:
            out = cut(out, "clean")
            sent.destroy()
    return out.drop(helper)


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The columns of the query: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and longest, longest_at."""
    c = contamination(docs, benchmark, window)
    return c.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
        "longest_at",
    )
