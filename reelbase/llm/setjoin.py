"""Exact Jaccard self-join of word n-gram sets with a token-group matrix.

1. Equal sets collapse to one representative.
2. A fixed-size sketch counts the shingles of all documents; each set is ordered by (count, hash), rarest first. Only a set's
   first shingles can decide a link (prefix filter), so only those travel, with a parity bitmap of the whole set.
3. *Groups.* A representative is compared with a few leaders, drawn by hash from the sets that share a prefix shingle. Links found
   so join similar sets into groups.
4. *Matrix.* The union of each group's prefix shingles is stored as rows (shingle, group) with the group's range of sizes and best
   remaining overlap, and the union of its bitmaps. A set queries the groups that hold one of its prefix shingles; from the sizes, the
   positions and the bitmap follows an upper bound of what it can share with any member. Only groups that reach the threshold
   are opened; the members that share an early shingle with the query pass the same bounds, then are compared in full.
5. Links join groups into components.

Every bound is rigorous, so no component is lost; the leaders of step 3 only save work. No step emits the pairs inside a group, unless links are to be counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import Memo, cut, free_name, lookup, map_batches, small_batches, utf8
from reelbase.llm.components import connected_components

SKETCH = 1 << 19  # counters of the sketch: fixed, 4 MB when it is broadcast
ROW = 1 << 13  # counters in one row of it
BITS = 1024  # of a set's bitmaps
MOST_BITS = 1 << 16  # of a long set's odd map
FILTER = 1 << 24  # bits of the id filter: fixed, 2 MB

_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingler(n: int):
    """Text as bytes -> sorted distinct 64-bit hashes of its ``n``-word shingles; fewer words are one shingle; none: empty.
    Words are runs of non-space bytes, A-Z lower-cased."""
    get = Memo(xxhash.xxh3_64_intdigest, 100_000).__getitem__

    def run(text: bytes) -> np.ndarray:
        w = text.lower().split()
        if not w:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(get, w), np.uint64, len(w))
        k = min(n, len(h))
        out = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            out = mixed(out * _P + h[i : len(h) - k + 1 + i])
        return np.unique(mixed(out + np.uint64(k)))

    return run


def odd_bits(n: int) -> int:
    """Bits of the odd map of a set of ``n`` tokens: about twice as many as tokens, in powers of two."""
    return min(MOST_BITS, max(BITS, 1 << (2 * n - 1).bit_length()))


def bitmaps(tokens: np.ndarray) -> tuple[bytes, bytes]:
    """Odd: bit i tells whether an odd number of tokens fall on i; two such bitmaps differ in at most as many bits as their sets
    differ in tokens. Any: whether some token falls on i; a bit of one set that another lacks is a token it lacks."""
    at = (tokens >> np.uint64(40)).astype(np.int64)
    size = odd_bits(len(tokens))
    odd = np.bincount(at & (size - 1), minlength=size) & 1 == 1
    return np.packbits(odd).tobytes(), np.packbits(np.bincount(at & (BITS - 1), minlength=BITS) > 0).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two odd maps differ, at the smaller one's size: a larger one folds onto it."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    elif len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def first_pass(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, sig, h) of every document, and how many sets hold a shingle of each of ``SKETCH`` cells, from one reading of the texts. Tasks
    count on their own, Spark adds the rows up; what comes to the driver has a fixed size."""

    def count(batches):
        shingles, total, names = shingler(n), np.zeros(SKETCH, np.int32), ["row", "id", "n", "data", "h"]
        for b in batches:
            parts = [shingles(t) for t in b.column(1).to_pylist()]
            if parts:
                total += np.bincount((np.concatenate(parts) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.int32)
                sig = pa.array([xxhash.xxh3_128_digest(p.tobytes()) for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.int64()), b.column(0), pa.array([len(p) for p in parts], pa.int64()), sig, b.column(2)], names)
        rows = total.reshape(-1, ROW)
        used = np.nonzero(rows.any(axis=1))[0]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), none, none, pa.array([rows[i].astype("<i8").tobytes() for i in used], pa.binary()), none], names)

    def add(frame):
        import pandas as pd

        return pd.DataFrame({"row": frame["row"][:1], "data": [np.sum([np.frombuffer(c, "<i8") for c in frame["data"]], axis=0, dtype=np.int64).tobytes()]})

    both = cut(docs.mapInArrow(count, "row long, id long, n long, data binary, h long"), "first-pass")
    some = both.where("row IS NOT NULL").select("row", "data").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy("row", "part").applyInPandas(add, "row long, data binary")
    total = np.zeros((SKETCH // ROW, ROW), np.int64)
    for r in some.groupBy("row").applyInPandas(add, "row long, data binary").collect():
        total[r["row"]] = np.frombuffer(r["data"], "<i8")
    return both.where("row IS NULL").select("id", "n", F.col("data").alias("sig"), "h"), total.ravel()


def signatures(docs: DataFrame, n: int, t: int, sketch: np.ndarray, sent) -> DataFrame:
    """Per document: ``h`` (hash of its text), ``n`` (set size), ``sig`` (of the whole set), ``bits`` and ``some`` (:func:`bitmaps`), ``prefix`` (first shingles, rarest first)
    and ``sure``: the filter ``sent`` does not hold its id."""
    rarity = docs.sparkSession.sparkContext.broadcast(np.minimum(sketch, 2**32 - 1).astype(np.uint32))

    def make():
        shingles, counts = shingler(n), rarity.value

        def run(b):
            size, sig, bits, some, prefix = [], [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text)
                m = len(s)
                size.append(m)
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                odd, any_ = bitmaps(s)
                bits.append(odd)
                some.append(any_)
                keep = m - -(-t * m // 100) + 1 if m else 0
                prefix.append(s[np.lexsort((s, counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[:keep]].view(np.int64))
            sure = pa.array(~in_filter(b.column(0), sent.value))
            columns = [b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(bits, pa.binary()), pa.array(some, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), sure]
            return pa.RecordBatch.from_arrays(columns, ["id", "h", "n", "sig", "bits", "some", "prefix", "sure"])

        return run

    return map_batches(docs, "id long, h long, n long, sig binary, bits binary, some binary, prefix array<long>, sure boolean", make)


def needed(t: int, a: Column, b: Column) -> Column:
    """Tokens that sets of sizes ``a`` and ``b`` must share to link: 100 * i >= t * (a + b - i)."""
    return F.ceil(F.lit(t) * (a + b) / F.lit(100.0 + t) - F.lit(1e-9))


#: A pair's sets by their keys, and the document (id, hash of its text) in which each set stands.
PAIR = "a long, b long, id_a long, h_a long, id_b long, h_b long"
PAIR_COLUMNS = ["a", "b", "id_a", "h_a", "id_b", "h_b"]


def bounded(t: int, pairs: DataFrame) -> DataFrame:
    """Pairs (PAIR with na, nb, bits_a, bits_b) that their sizes and bitmaps let link."""

    def run(batches):
        for b in batches:
            na, nb = (b.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            diff = np.maximum(np.fromiter(map(differing, b.column("bits_a").to_pylist(), b.column("bits_b").to_pylist()), np.int64, b.num_rows), np.abs(na - nb))
            shared = (na + nb - diff) // 2
            keep = 100 * shared >= t * (na + nb - shared)
            yield b.select(PAIR_COLUMNS).filter(pa.array(keep))

    return pairs.select(*PAIR_COLUMNS, "na", "nb", "bits_a", "bits_b").mapInArrow(run, PAIR)


def filter_cells(values: pa.Array) -> np.ndarray:
    return (mixed(values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) & np.uint64(FILTER - 1)).astype(np.int64)


def in_filter(values: pa.Array, bits: np.ndarray) -> np.ndarray:
    c = filter_cells(values)
    return (bits[c >> 6] >> (c & 63)) & 1 == 1


def filter_of(values: DataFrame):
    """A broadcast bit array of fixed size that holds the values (longs) of a one-column table, for :func:`maybe_in`."""

    def cells(batches):
        for b in batches:
            c = filter_cells(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(c >> 6), pa.array(np.left_shift(np.int64(1), c & 63))], ["word", "bit"])

    array = np.zeros(FILTER >> 6, np.int64)
    for b in values.mapInArrow(cells, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_batches():
        array[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return values.sparkSession.sparkContext.broadcast(array)


def maybe_in(rows: DataFrame, column: str, sent) -> DataFrame:
    """The rows whose ``column`` may be among the filter's values, so that a join need not move the others. What passes in error, the
    join removes."""
    at = rows.columns.index(column)

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(in_filter(b.column(at), sent.value)))

    return rows.mapInArrow(keep, rows.schema)


def linked(t: int, n: int, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of PAIR that link, by their whole sets, which are rebuilt from just these documents."""
    pairs = cut(pairs.distinct(), "pairs")
    wanted = pairs.selectExpr("a AS key", "id_a AS id", "h_a AS h").union(pairs.selectExpr("b", "id_b", "h_b")).distinct()
    sent = filter_of(wanted.select("id"))

    def make():
        shingles = shingler(n)

        def run(b):
            b = b.filter(pa.array(in_filter(b.column(0), sent.value)))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([shingles(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["id", "h", "tokens"])

        return run

    sets = map_batches(docs.select("id", "text", "h"), "id long, h long, tokens binary", make).join(wanted, ["id", "h"]).select("key", "tokens")
    sets = cut(sets.dropDuplicates(["key"]), "sets")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("tb")), "b")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * shared >= t * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def set_keys(seen: DataFrame) -> tuple[DataFrame, bool]:
    """(sig, rep, key, rows) of every distinct set: the smallest id that has it, a number of its own, and how many rows have it. The number is that id, unless
    documents of one id have several sets; all but one of them get numbers above every id. And whether there are such numbers."""
    reps = cut(seen.where("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")), "reps")
    first = reps.groupBy("rep").agg(F.min("sig").alias("least"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select("rep", "least")
    several = cut(reps.join(first, "rep").where("sig <> least").select("sig"), "several")
    if several.isEmpty():
        return reps.withColumn("key", F.col("rep")), False
    top = seen.agg(F.max("id")).first()[0]
    extra = cut(several.withColumn("own", F.monotonically_increasing_id() + F.lit(top + 1)), "keys")
    return reps.join(extra, "sig", "left").select("sig", "rep", "rows", F.coalesce("own", "rep").alias("key")), True


def ngram_jaccard_components(docs: DataFrame, n: int = 5, threshold: int = 80, leaders: int = 6, id_col: str = "doc_id", text_col: str = "text", count_links: bool = False) -> DataFrame:
    """Per document: id, ``n_shingles``, ``component_id`` (smallest id that links reach); with ``count_links`` also ``links``, how many other distinct
    sets its set links with. Components do not need the pairs inside a group, of which there are as many as the square of its size; the count
    does, and compares them all in full.

    Two documents link when 100 * intersection >= ``threshold`` * union of their sets of ``n``-word shingles. Null, empty and
    space-only texts have no shingles and link with nothing. Equal sets share a component. Rows of one id with different texts are documents of their own
    that happen to have one id: each gets the component of its own text. Ids are integers; a row without one links with nothing and has a null
    component.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    small_batches(docs.sparkSession)
    seen, by_sig = set_components(texts.where("id IS NOT NULL"), n, threshold, leaders, count_links)
    counted = [F.coalesce("links", F.lit(0)).cast("long").alias("links")] if count_links else []
    placed = lookup(seen.where("n > 0"), by_sig, "sig", "rows").select("id", "n", "component_id", *counted)
    bare = seen.where("n = 0").select("id", "n", F.col("id").alias("component_id"), *[F.lit(0).cast("long").alias("links")][: len(counted)])
    out = placed.unionByName(bare).withColumnsRenamed({"id": id_col, "n": "n_shingles"})

    def make():
        shingles = shingler(n)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([len(shingles(x)) for x in b.column(1).to_pylist()], pa.int64())], ["id", "n"])

    alone = map_batches(texts.where("id IS NULL"), "id long, n long", make).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(alone.withColumn("links", F.lit(0).cast("long")) if count_links else alone)


def set_components(texts: DataFrame, n: int, t: int, leaders: int, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """Of (id, text, h): (id, n, sig, h) of every row, and a written table (sig, rows, component, component_id) of every distinct
    set, with ``links`` if they are to be counted. ``component`` tells components apart that share their smallest id."""
    seen, sketch = first_pass(texts, n)
    reps, numbered = set_keys(seen)
    # sets whose id no other row can have are taken as they are; only the others move to be held against the representatives
    plain = reps.where("rep = key AND rows = 1").select(F.col("rep").alias("id"), "sig")
    others = filter_of(seen.where("n > 0").join(plain, ["id", "sig"], "left_anti").select("id"))
    every = cut(signatures(texts, n, t, sketch, others).where("n > 0"), "signatures")
    doubtful = every.where("NOT sure").join(reps.select(F.col("rep").alias("id"), "sig", "key"), ["id", "sig"])
    columns = ["key AS id", "id AS at", "h", "n", "bits", "some", "prefix"]
    doubtful = cut(doubtful.selectExpr(*columns).dropDuplicates(["id"]), "sets")
    # a filter never misses an id that it holds, so a set that is sure is the only one of its id
    sets = every.where("sure").selectExpr("id AS key", "*").selectExpr(*columns).union(doubtful)
    info = sets.select("id", "at", "h", "n", "bits")

    # postings of the shingles that more than one set has in its prefix; the others are counted, and stay where they are
    tokens = sets.select(F.explode("prefix").alias("token"))
    shared = filter_of(tokens.groupBy("token").count().where("count > 1").select("token"))
    rows = maybe_in(sets.select("id", F.col("n").cast("int").alias("size"), F.posexplode("prefix").alias("pos", "token")), "token", shared)
    # the leader is a set in which the shingle comes early: few rarer ones, so it is near the middle of its kind
    central = F.col("pos").cast("long") * 1048576 + F.pmod(F.xxhash64("id", "token"), F.lit(1048576))
    rows = cut(rows, "rows")
    leading = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min_by("id", central).alias("leader")).where("df > 1").drop("df")
    postings = cut(rows.join(leading, "token"), "postings")

    # groups: links with a few leaders
    few = postings.groupBy("id", "size").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("token", "leader").alias("h"), "leader"))), 1, leaders).alias("s"))
    stars = few.select("id", F.explode(F.array_distinct(F.transform("s", lambda x: x["leader"]))).alias("b")).where("id <> b").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    star_links = cut(linked(t, n, bounded(t, with_info(cut(stars, "stars"), info, t)), texts), "links")
    groups = connected_components(star_links)
    placed = cut(postings.drop("leader").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component"), "placed")

    # the matrix: groups (sets of one size within what the leaders joined) that share a shingle with another group
    sizes = sets.select("id").join(groups, "id", "left").groupBy(F.coalesce("component", "id").alias("group")).agg(F.count(F.lit(1)).alias("members"))
    # how many rows have a group follows its members
    g_size = cut(sizes.withColumn("weight", F.col("members")), "group-sizes")
    matrix = placed.groupBy("token", "group", F.col("size").alias("other")).agg(F.max(F.col("size") - F.col("pos")).alias("rest"))
    mixed_tokens = matrix.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).where("g0 <> g1").select("token")
    matrix = lookup(cut(matrix.join(mixed_tokens, "token", "left_semi"), "matrix"), g_size, "group", "weight")
    queries = lookup(cut(placed.join(mixed_tokens, "token", "left_semi"), "mixed"), g_size.withColumnRenamed("members", "own_members"), "group", "weight").withColumnRenamed("group", "own")
    hits = (
        queries.join(matrix, "token")
        .where("own <> group")
        .where(F.struct("own_members", "own") < F.struct("members", "group"))
        .where((F.col("other") * 100 >= F.col("size") * t) & (F.col("other") * t <= F.col("size") * 100))
        .where(F.least(F.col("size") - F.col("pos"), "rest") >= needed(t, F.col("size"), F.col("other")))
        .select("id", "size", "group", "other")
        .distinct()
    )
    hits = cut(hits, "hits")
    asked = hits.select("group", F.struct("group", "other").alias("part")).distinct().join(g_size.select("group", "weight"), "group").select("part", "weight")
    members = sets.select("id", F.col("n").cast("int").alias("other"), "some").join(groups, "id", "left").withColumn("group", F.coalesce("component", "id"))
    members = lookup(members.select("group", "other", "some", F.struct("group", "other").alias("part")), cut(asked, "asked"), "part", "weight")
    # what a group's union of bitmaps lacks of a set's bitmap, no member has
    opened = cut(qualified(t, hits.join(sets.select("id", "some"), "id").join(unions(members), ["group", "other"])), "opened")
    cross = linked(t, n, bounded(t, with_info(cut(met(t, opened, placed), "met"), info, t)), texts)
    links = cut(star_links.union(cross), "links")
    comp = connected_components(links)
    by_sig = reps.join(comp, reps.key == comp.id, "left").select("sig", "rep", "rows", "key", F.coalesce("component", "key").alias("component"))
    if numbered:  # the smallest id of a component, whose sets may have numbers of their own
        by_sig = cut(by_sig, "found")
        least = by_sig.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("weight"))
        by_sig = lookup(by_sig, cut(least, "components"), "component", "weight")
    else:
        by_sig = by_sig.withColumn("component_id", F.col("component"))
    if count_links:
        inner = linked(t, n, bounded(t, with_info(cut(within(t, placed), "within"), info, t)), texts)
        pairs = links.union(inner).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        count = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("links"))
        by_sig = by_sig.join(count, "key", "left")
    return seen, cut(by_sig.drop("key", "rep"), "components")


def with_info(pairs: DataFrame, info: DataFrame, t: int) -> DataFrame:
    info = maybe_in(info, "id", filter_of(pairs.select("a").union(pairs.select("b"))))
    a, b = (info.select(F.col("id").alias(x), F.col("at").alias(f"id_{x}"), F.col("h").alias(f"h_{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where((F.col("na") * 100 >= F.col("nb") * t) & (F.col("na") * t <= F.col("nb") * 100))


def unions(members: DataFrame) -> DataFrame:
    """The OR of the bitmaps of each group, by 64-bit words, added up map-side."""
    words = [F.bit_or(F.expr(f"cast(conv(hex(substring(some, {8 * k + 1}, 8)), 16, -10) as bigint)")).alias(f"w{k}") for k in range(BITS // 64)]
    return members.groupBy("group", "other").agg(*words)


def qualified(t: int, hits: DataFrame) -> DataFrame:
    """(group, nb, a, na) of the queries that can share enough tokens with the union of the group's sets of size nb."""
    words = [f"w{k}" for k in range(BITS // 64)]

    def run(batches):
        for b in batches:
            own = np.frombuffer(b"".join(b.column("some").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            union = np.stack([b.column(w).to_numpy(zero_copy_only=False) for w in words], axis=1).astype(">i8").view(np.uint8).reshape(-1, BITS // 8)
            size, other = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("size", "other"))
            most = size - np.bitwise_count(own & ~union).sum(axis=1, dtype=np.int64)
            keep = (100 + t) * most >= t * (size + other)
            yield pa.RecordBatch.from_arrays([b.column("group"), pa.array(other), b.column("id"), pa.array(size)], ["group", "nb", "a", "na"]).filter(pa.array(keep))

    return hits.mapInArrow(run, "group long, nb long, a long, na long")


def met(t: int, opened: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of a query and a member of a group it opens that have a prefix shingle in common, early enough in both to link.
    A query in the midst of a large group meets few of its members so: what its own edits and theirs changed comes first."""
    early = F.col("size") - F.col("pos")
    asking = opened.join(placed.select(F.col("id").alias("a"), "token", "size", "pos"), "a").where(early >= needed(t, F.col("na"), F.col("nb"))).select("a", "na", "group", "nb", "token")
    held = placed.select("group", F.col("size").cast("long").alias("nb"), "token", F.col("id").alias("b"), early.alias("rest")).join(opened.select("group", "nb").distinct(), ["group", "nb"], "left_semi")
    both = asking.join(held, ["group", "nb", "token"])
    return both.where(F.col("rest") >= needed(t, F.col("na"), F.col("nb"))).select("a", "b").distinct()


def within(t: int, placed: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of members of one group that have a prefix shingle in common, early enough in both to link."""
    early = (F.col("size") - F.col("pos")).alias("rest")
    one = placed.select("group", "token", F.col("id").alias("a"), F.col("size").cast("long").alias("na"), early.alias("ra"))
    other = placed.select("group", "token", F.col("id").alias("b"), F.col("size").cast("long").alias("nb"), early.alias("rb"))
    both = one.join(other, ["group", "token"]).where("a < b").where((F.col("na") * 100 >= F.col("nb") * t) & (F.col("na") * t <= F.col("nb") * 100))
    return both.where(F.least("ra", "rb") >= needed(t, F.col("na"), F.col("nb"))).select("a", "b").distinct()


def deduplicated(docs: DataFrame, n: int = 5, threshold: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component stays, with all its columns: that with the smallest id, of several with that id one by a hash of their texts, of
    rows with one id and text any one. Rows without shingles or without an id stay."""
    small_batches(docs.sparkSession)
    row, own = free_name(docs, "_h"), free_name(docs, "_at")
    keyed = docs.withColumn(row, F.xxhash64(utf8(text_col))).withColumn(own, F.col(id_col).cast("long"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    seen, by_sig = set_components(texts.where("id IS NOT NULL"), n, threshold, 6, False)
    placed = cut(lookup(seen.where("n > 0"), by_sig, "sig", "rows").groupBy("id", "h", "component").agg(F.count(F.lit(1)).alias("rows")), "placed")
    stays = placed.groupBy("component").agg(F.min(F.struct("id", "h")).alias("kept"), F.count(F.lit(1)).alias("texts"), F.max("rows").alias("rows")).where("texts > 1 OR rows > 1")
    stays = cut(stays.selectExpr("component", "kept.id AS id", "kept.h AS h", "texts AS weight"), "kept")
    kept = stays.selectExpr("component", "id AS kept_id", "h AS kept_h", "weight")
    gone = lookup(placed, kept, "component", "weight").where("id <> kept_id OR h <> kept_h").selectExpr(f"id AS {own}", f"h AS {row}")
    many = cut(placed.where("rows > 1").join(stays.select("id", "h"), ["id", "h"], "left_semi").selectExpr(f"id AS {own}", f"h AS {row}"), "repeated")
    left = keyed.join(cut(gone, "gone"), [own, row], "left_anti")
    if not many.isEmpty():
        left = left.join(many, [own, row], "left_anti").unionByName(left.join(many, [own, row], "left_semi").dropDuplicates([own, row]))
    return left.select(*docs.columns)
