"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is the bag of its words, a word's weight is how often it occurs. For each of ``samples`` draws, each word gets
two Gamma(2, 1) variables r and c and a uniform b, all from a hash of the word; with weight w, t = floor(ln w / r + b) and
ln a = ln c - r * (t - b + 1). The word with the smallest a is the draw. Since c is continuous, a itself names the word and t, so the
minimum is the sample: two texts get the same one with a probability equal to their generalised Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import cut
from reelbase.operators.ranks import range_of, spread_bounds

SAMPLES = 32
DRAWN = 16  # rows drawn for each range
COARSE = 128  # ranges whose bounds are literals; each is cut further by bounds that are sent as a table
MOST_SLOTS = 1 << 19  # ranges at most, so the bounds (16 bytes each) and the ranges' first rows are a bounded number; beyond it ranges grow with the input


def spread_slots(ids: DataFrame, slots: int) -> Callable[[DataFrame], DataFrame]:
    """What adds ``slot``, the number of the range that (doc_id, h) falls in, rising with it. ``ids`` has doc_id, h (a hash of the text) and bytes, and is a written table.

    Bounds are drawn from the rows themselves by hash, half by number and half by bytes, so ids may lie as they like, and rows of one id are
    divided by their texts. Only repeated rows of one id and text stay together. Coarse bounds are literals, fine ones a sorted array for each coarse range."""
    if slots < 2:
        return lambda rows: rows.withColumn("slot", F.lit(0))
    bounds = spread_bounds(ids, ["doc_id", "h"], min(COARSE, slots), small=1)
    fine = -(-slots // (len(bounds) + 1))
    coarse = lambda rows: rows.withColumn("_p", range_of(rows, ["doc_id", "h"], bounds))
    if fine < 2:
        return lambda rows: coarse(rows).withColumnRenamed("_p", "slot")
    n, size = ids.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    share = DRAWN * slots * (0.5 / n + F.col("bytes") * (0.5 / max(size, 1)))
    drawn = coarse(ids.where(F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit("bound")), 11) / float(1 << 53) < share))
    # a coarse range has some DRAWN * slots / COARSE drawn rows, 65,536 at most slots
    place = "(row_number() OVER (PARTITION BY _p ORDER BY doc_id, h) - 1)"
    step = f"floor({place} * {fine}L / count(*) OVER (PARTITION BY _p))"
    ends = drawn.selectExpr("_p", "doc_id", "h", f"{step} AS step").groupBy("_p", "step").agg(F.min(F.struct("doc_id", "h")).alias("b")).where("step > 0")
    arrays = ends.groupBy("_p").agg(F.array_sort(F.collect_set("b")).alias("_bounds"))  # COARSE rows of fine - 1 bounds at most
    halvings = fine.bit_length()
    # how many bounds are no larger than the row's own place, by halving
    mid = "cast((z.lo + z.hi) div 2 as int)"
    found = f"""aggregate(sequence(1, {halvings}), named_struct('lo', 0, 'hi', size(_bounds)),
      (z, i) -> if(z.lo >= z.hi, z, if(_bounds[{mid}] <= _key, named_struct('lo', {mid} + 1, 'hi', z.hi), named_struct('lo', z.lo, 'hi', {mid}))), z -> z.lo)"""

    def add(rows: DataFrame) -> DataFrame:
        met = coarse(rows).join(F.broadcast(arrays), "_p", "left").withColumn("_key", F.struct("doc_id", "h"))
        return met.withColumn("slot", F.col("_p") * fine + F.coalesce(F.expr(found), F.lit(0))).drop("_p", "_bounds", "_key")

    return add


def with_next(docs: DataFrame, ids: DataFrame, slots: int, partitions: int) -> DataFrame:
    """slot, rn, ghost, doc_id, text, next_text: the document that follows in descending doc_id; the last is followed by the first.

    The documents are dealt once, by ranges of ids (slots), and ordered inside their range. The last of a range needs the first of
    the range below: that one row per range is dealt to both, as a ghost."""
    add = spread_slots(ids, slots)
    tops = add(ids.select("doc_id", "h")).groupBy("slot").agg(F.max(F.struct("doc_id", "h")).alias("top"))  # one row for each range
    # MOST_SLOTS rows at most in this window, and as many that are broadcast (12 MB)
    above = tops.selectExpr("top.doc_id AS doc_id", "top.h AS h", "coalesce(lead(slot) OVER (ORDER BY slot), min(slot) OVER (), 0) AS slot")
    ghosts = docs.join(F.broadcast(above), ["doc_id", "h"]).groupBy("slot", "doc_id", "h").agg(F.min("text").alias("text"))
    both = add(docs).select("slot", "doc_id", "h", "text", F.lit(0).alias("ghost")).unionByName(ghosts.withColumn("ghost", F.lit(1))).repartition(partitions, "slot")
    over = "OVER (PARTITION BY slot ORDER BY ghost, doc_id DESC, h DESC, text)"
    return both.selectExpr("slot", f"row_number() {over} AS rn", "ghost", "doc_id", "text", f"lead(text) {over} AS next_text")


def draws(word_hash: str, ln_w: str, samples: int) -> list[Column]:
    """ln a of each draw, from two hashes of 64 bits: five uniforms of 25 bits and more."""
    out = []
    for k in range(samples):
        h, g = f"xxhash64({word_hash}, {2 * k + 1})", f"xxhash64({word_hash}, {2 * k + 2})"
        part = lambda x, low: f"(((shiftrightunsigned({x}, {low}) & 2097151L) + 0.5D) / 2097152D)"
        r = f"(-ln({part(h, 0)} * {part(h, 21)}))"
        out.append(F.expr(f"ln(-ln({part(g, 0)} * {part(g, 21)})) - {r} * (floor({ln_w} / {r} + {part(h, 42)}) - {part(h, 42)} + 1)"))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` of each row of ``texts`` whose text has words. Rows must differ in ``keys``. If ``texts`` is dealt by some of
    ``keys``, nothing is shuffled."""
    words = texts.select(*keys, F.explode(F.split(F.lower(text_col), r"\s+")).alias("word")).where("word <> ''").select(*keys, F.xxhash64("word").alias("h"))
    weights = words.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("w")).select(*keys, "h", F.expr("ln(w)").alias("ln_w"))
    least = weights.groupBy(*keys).agg(*[F.min(x).alias(f"s{k}") for k, x in enumerate(draws("h", "ln_w", samples))])
    return least.select(*keys, F.concat(*[F.lpad(F.hex(F.xxhash64(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(samples)]).alias("fingerprint"))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """The share of equal samples. Two empty fingerprints (no words) are alike, an empty one is unlike any other."""
    same = " + ".join(f"int(substring({a}, {8 * k + 1}, 8) = substring({b}, {8 * k + 1}, 8))" for k in range(samples))
    return F.expr(f"CASE WHEN {a} = {b} THEN 1D WHEN {a} = '' OR {b} = '' THEN 0D ELSE ({same}) / {samples}D END")


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, slot_bytes: int = 2 << 20, partition_bytes: int = 8 << 20, most_slots: int = MOST_SLOTS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document, by descending
    doc_id (after the last: the first; a single document is its own next; of rows with one id, by a hash of their text). Null texts are empty; a text
    without words has the empty fingerprint. Equal texts have equal fingerprints. doc_id is an integer; a null one comes after all others. Repeated rows
    are each reported. Other columns are left out. Texts move once, dealt by ranges of doc_id; their words are counted and drawn where they are.
    """
    least = docs.agg(F.min(F.col("doc_id").cast("long"))).first()[0]
    lowest = max((least or 0) - 1, -(1 << 63) + 1)  # stands for a null id on the way
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = cut(own.select("doc_id", "h", F.octet_length("text").alias("bytes")), "fingerprint-ids")
    size = ids.agg(F.sum("bytes")).first()[0] or 0
    base = with_next(own, ids, min(size // slot_bytes + 1, most_slots), size // partition_bytes + 1)
    half = "cast(char_length(text) div 2 as int)"
    texts = base.selectExpr("slot", "rn", "ghost", "doc_id", "text", f"concat(substring(text, 1, char_length(text) - {half}), substring(next_text, 1, {half})) AS edited")
    kinds = texts.selectExpr("slot", "rn", "explode(if(ghost = 1, array(struct(0 AS kind, text AS t)), array(struct(0 AS kind, text AS t), struct(1 AS kind, edited AS t)))) AS x").selectExpr("slot", "rn", "x.kind AS kind", "x.t AS t")
    prints = fingerprints(kinds, ["slot", "rn", "kind"], "t", samples).groupBy("slot", "rn").agg(*[F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(f"p{k}") for k in (0, 1)])
    meta = texts.selectExpr("slot", "rn", "ghost", "doc_id", "cast(char_length(text) as long) AS n_chars", "sha2(edited, 256) AS edited_sha256")
    both = meta.join(prints, ["slot", "rn"], "left").selectExpr("slot", "rn", "ghost", "doc_id", "n_chars", "edited_sha256", "coalesce(p0, '') AS fingerprint", "coalesce(p1, '') AS edited_fingerprint")
    ahead = both.selectExpr("*", "lead(fingerprint) OVER (PARTITION BY slot ORDER BY rn) AS next_fingerprint").where("ghost = 0")
    return ahead.select(F.nullif("doc_id", F.lit(lowest)).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint", samples).alias("near_edited"), likeness("fingerprint", "next_fingerprint", samples).alias("near_next"))
