"""Removal of boilerplate lines by the number of distinct sites that hold them.

Per line hash, HyperLogLog sketches of the sites merge in an aggregation. Lines whose estimate is clear of the threshold are
decided by it; those near the threshold get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelbase.llm.common import cut, free_name, lookup

LG_K = 12  # 4,096 registers: a relative error of 1.6 %


def line_table(docs: DataFrame, row: str, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """id, row (hash of the text), pos, h (128-bit hash of the trimmed line), site (hash). Blank lines are left out."""
    site = F.xxhash64(F.coalesce(F.col(site_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(row).alias("row"), site.alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    line = rows.select("id", "row", "pos", F.trim("line").alias("line"), "site").where("line <> ''")
    return line.select("id", "row", "pos", F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).alias("h"), "site")


def spread_lines(lines: DataFrame, min_sites: int, most_frequent: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """h, ``first`` (smallest id that holds it) and n (how many rows do) of the lines on at least ``min_sites`` distinct sites; and the at most
    ``most_frequent`` lines, on however many sites, that hold a large part of all rows."""
    counted = lines.groupBy("h").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    least = max(1000, -(-lines.count() // most_frequent))
    kept = cut(counted.where((F.col("a") != F.col("b")) | (F.col("n") >= least)).select("h", "first", "n", (F.col("a") != F.col("b")).alias("several")), "several")
    several, frequent = kept.where("several").drop("several"), kept.where(F.col("n") >= least).select("h")
    held = lookup(lines.select("h", "site"), several.select("h", "n"), "h", "n", frequent=frequent)
    sketches = held.groupBy("h", F.pmod(F.xxhash64("site", "h"), F.lit(8)).alias("part")).agg(F.hll_sketch_agg("site", LG_K).alias("s")).groupBy("h").agg(F.hll_union_agg("s").alias("s"))
    margin = max(1.0, min_sites * 3 * 1.04 / 2 ** (LG_K / 2))
    judged = cut(sketches.select("h", F.hll_sketch_estimate("s").alias("sites")).where(F.col("sites") >= min_sites - margin), "judged")
    sure = judged.where(F.col("sites") > min_sites + margin).select("h")
    near = judged.where(F.col("sites") <= min_sites + margin).join(several, "h").select("h", "n")
    exact = lookup(lines.select("h", "site"), cut(near, "near"), "h", "n", frequent=frequent).distinct().groupBy("h").count().where(F.col("count") >= min_sites).select("h")
    return several.join(sure.union(exact), "h", "left_semi"), frequent


def line_dedup(docs: DataFrame, min_sites: int = 3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All columns of ``docs`` with spread lines taken out of ``text_col``, and ``lines_total``, ``lines_removed``.

    A line is spread when at least ``min_sites`` distinct sites hold it (trimmed; a null site counts as one site). It stays in the document
    with the smallest id, so that its text is not lost, and goes from all others. Blank lines stay. Null texts stay null, with no lines; a
    null id never is the first. Repeated rows are treated alike. Clashing column names: ``lines_total`` and ``lines_removed`` are replaced, no
    others. A line's identity is a hash of 128 bits.
    """
    kept_names = [c for c in docs.columns if c not in ("lines_total", "lines_removed")]
    docs = docs.select(*kept_names)
    row, parts, gone_at, gone_id, gone_row = (free_name(docs, c) for c in ("_row", "_lines", "_gone", "_id", "_of_row"))
    keyed = docs.withColumn(row, F.xxhash64(text_col))
    lines = cut(line_table(keyed, row, id_col, text_col, site_col), "lines")
    spread, frequent = spread_lines(lines, min_sites)
    held = lookup(lines.select("id", "row", "pos", "h"), cut(spread, "spread"), "h", "n", frequent=frequent).where("id <> first OR first IS NULL OR id IS NULL")
    gone = held.groupBy(F.col("id").alias(gone_id), F.col("row").alias(gone_row)).agg(F.collect_set("pos").alias(gone_at))
    both = keyed.join(gone, keyed[id_col].eqNullSafe(F.col(gone_id)) & (keyed[row] == F.col(gone_row)), "left").withColumn(parts, F.split(text_col, "\n"))
    left = f"transform(filter(transform({parts}, (x, i) -> struct(x AS l, i AS i)), y -> NOT array_contains({gone_at}, y.i)), y -> y.l)"
    text = F.when(F.col(gone_at).isNull(), F.col(text_col)).otherwise(F.array_join(F.expr(left), "\n"))
    total = F.coalesce(F.expr(f"size(filter({parts}, l -> trim(l) <> ''))"), F.lit(0)).cast("long")
    return both.withColumn(text_col, text).select(*kept_names, total.alias("lines_total"), F.coalesce(F.greatest(F.size(gone_at), F.lit(0)), F.lit(0)).cast("long").alias("lines_removed"))


def without_spread_lines(docs: DataFrame, min_sites: int = 3) -> DataFrame:
    """``docs`` (with text, source, n_chars) without spread lines. Documents of which nothing is left go; those that had no line to begin with stay.
    ``n_chars`` follows the text where that changed."""
    out = line_dedup(docs, min_sites).where("NOT (lines_removed > 0 AND lines_removed >= lines_total)")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def digest(docs: DataFrame, min_sites: int = 3) -> DataFrame:
    """The columns of the query: doc_id, n_lines, n_removed, kept_sha256 (null for a null text)."""
    return line_dedup(docs.select("doc_id", "text", "source"), min_sites).select("doc_id", F.col("lines_total").alias("n_lines"), F.greatest("lines_removed", F.lit(0)).alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT d.doc_id, coalesce(d.source, '') AS site, u.i AS pos, trim(l[u.i]) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, len(d.l) + 1)) AS u(i)
), spread AS (
  SELECT line, min(doc_id) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 3
), kept AS (
  SELECT d.doc_id, count(*) FILTER (WHERE x.line <> '') AS n_lines,
         count(*) FILTER (WHERE s.line IS NOT NULL AND s.first <> d.doc_id) AS n_removed,
         string_agg(string_split(d.text, chr(10))[x.pos], chr(10) ORDER BY x.pos) FILTER (WHERE s.line IS NULL OR s.first = d.doc_id) AS kept
  FROM documents d JOIN lines x USING (doc_id) LEFT JOIN spread s ON x.line = s.line GROUP BY d.doc_id
)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM kept
"""
