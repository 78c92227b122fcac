"""Queries of sources that are folders of files: each writes the files from the given tables, then lists or reads them."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.queries.base import REPO, SLOT, query
from reelbase.queries.datasets import written
from reelbase.sources import datasets as D
from reelbase.sources import files, pools
from reelbase.sources.adapters import read


@query("src_09_discover", f"SELECT DISTINCT {REPO} AS repo_id FROM frames WHERE {SLOT} = 'left'")
def src_09(s, d):
    return D.discovered(s, written(s, d, meta=False), "_left_[0-9]+$")


CHECKPOINT = "CASE WHEN l_orderkey % 3 = 0 THEN lpad(l_orderkey::VARCHAR, 9, '0') ELSE l_orderkey::VARCHAR END"


@query("src_10_checkpoints", f"SELECT l_orderkey AS step, {CHECKPOINT} || '/pretrained_model' AS path FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 25 = 0) WHERE l_orderkey % 4 <> 1")
def src_10(s, d):
    """Every 25th order is a training step; every fourth of those, by its key, was saved without the model, and some folders are no steps."""
    root, k = D.fresh_folder(s, "checkpoints"), F.col("l_orderkey")
    steps = read(s, d, "lineitem").where(k % 25 == 0).select("l_orderkey").distinct()
    text = k.cast("string")
    folder = F.when(k % 3 == 0, F.lpad(text, 9, "0")).otherwise(text)
    inside = F.when(k % 4 == 1, F.lit("optimizer/state")).otherwise(F.lit("pretrained_model/weights"))
    step = steps.select(F.concat_ws("/", folder, inside).alias("path"), text.cast("binary").alias("content"))
    other = steps.where(k % 100 == 0).select(F.concat(F.lit("tmp-"), text, F.lit("/pretrained_model/weights")).alias("path"), text.cast("binary").alias("content"))
    files.write_files(files.dealt(step.unionByName(other), "path"), root)
    return files.checkpoints(s, root)


def image_bytes(kind, w, h, key):
    """The start of a picture, as bytes: the headers are real, the picture data is not."""
    big = lambda x, n: F.unhex(F.lpad(F.hex(x), 2 * n, "0"))
    little = lambda x: F.concat(big(x % 256, 1), big(F.floor(x / 256), 1))
    fixed = lambda text: F.unhex(F.lit(text))
    png = F.concat(fixed("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4))
    gif = F.concat(F.lit("GIF89a").cast("binary"), little(w), little(h))
    comment = 2 + (key % 50) * 997  # a segment of varying length before the frame header
    jpeg = F.concat(fixed("FFD8FFE000104A46494600010100000100010000FFFE"), big(comment, 2), F.repeat(F.lit("c"), (comment - 2).cast("int")).cast("binary"), fixed("FFC2001108"), big(h, 2), big(w, 2))
    start = F.when(kind == 0, png).when(kind == 1, gif).otherwise(jpeg)
    return F.concat(start, F.repeat(F.lit("\0"), (500 + key % 3000).cast("int")).cast("binary"))


@query("src_11_image_headers", """SELECT p_brand, p_partkey, ['png', 'gif', 'jpeg'][CAST(p_partkey % 3 AS INT) + 1] AS format, CAST(200 + (p_partkey * 31) % 700 AS INT) AS width, CAST(200 + (p_partkey * 47) % 700 AS INT) AS height
 FROM part WHERE p_partkey % 11 <> 0""")
def src_11(s, d):
    """Pictures of every part, every eleventh cut off inside its header."""
    root, k = D.fresh_folder(s, "images"), F.col("p_partkey")
    content = image_bytes(k % 3, 200 + (k * 31) % 700, 200 + (k * 47) % 700, k)
    ending = F.element_at(F.array(F.lit("png"), F.lit("gif"), F.lit("JPG")), (k % 3 + 1).cast("int"))
    rows = files.dealt(read(s, d, "part").select("p_brand", "p_partkey"), "p_partkey").select(F.concat(F.col("p_brand"), F.lit("/"), k.cast("string"), F.lit("."), ending).alias("path"), F.when(k % 11 == 0, F.substring(content, 1, 8)).otherwise(content).alias("content"))
    files.write_files(rows, root)
    found = files.image_headers(s, root, shares=4)
    return found.select(F.col("dir").alias("p_brand"), F.split_part("name", F.lit("."), F.lit(1)).cast("long").alias("p_partkey"), "format", "width", "height")


@query("src_12_inventory", "SELECT coalesce(nullif(split_part(split_part(url, '://', 2), '/', 1), ''), 'none') AS dir, count(*) AS files, CAST(sum(coalesce(strlen(html), 0)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def src_12(s, d):
    root = D.fresh_folder(s, "pages")
    host = F.coalesce(F.expr("nullif(split_part(split_part(url, '://', 2), '/', 1), '')"), F.lit("none"))
    files.write_files(files.dealt(read(s, d, "pages").select("page_id", "url", "html"), "page_id").select(F.concat_ws("/", host, F.concat(F.col("page_id").cast("string"), F.lit(".html"))).alias("path"), F.col("html").cast("binary").alias("content")), root)
    return D.inventory(files.listing(s, root).where("not is_dir").withColumnRenamed("bytes", "length"), "dir")


def photo_files(s, d, folder, depth=1):
    """A photo of each part in the folder that ``folder`` names, ``depth`` below the root, and the root's listing, planned by those folders."""
    root = D.fresh_folder(s, "photos")
    name = F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".jpg"))
    files.write_files(files.dealt(read(s, d, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.concat_ws("/", folder, name).alias("path"), F.lit(None).cast("binary").alias("content")), root)
    return root, files.listing(s, root, depth=depth)


def pool_file(entries, root, name, **more):
    """One pretty-printed object of all entries; a pool has an entry for each identity, so it is small."""
    fields = [F.lit(v).alias(k) for k, v in more.items()]
    text = F.to_json(F.struct(*fields, F.array_sort(F.collect_list(F.struct(*entries.columns))).alias("celebrities")), {"pretty": "true"})
    files.write_files(entries.agg(text.cast("binary").alias("content")).select(F.lit(name).alias("path"), "content"), root)
    return f"{root}/{name}"


@query("src_06_rectangular_pool", """WITH k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 2, p_partkey) - 1 AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part
 WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#5') AND (p_partkey % 2 = 0 OR p_brand <> 'Brand#5')) SELECT p_brand, p_partkey, rank FROM k WHERE rank < (SELECT min(n) FROM k)""")
def src_06(s, d):
    """Two pool files: the first lists the folder of even parts of each brand, the second that of odd ones, of all brands but one, and says other things of them."""
    side = F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b")
    root, listing = photo_files(s, d, F.concat_ws("/", side, F.col("p_brand")), depth=2)
    brands = read(s, d, "part").select(F.col("p_brand").alias("slug")).distinct()
    first = brands.select("slug", F.concat(F.lit("a/"), "slug").alias("dir"), F.upper("slug").alias("name"))
    second = brands.where("slug <> 'Brand#5'").select("slug", F.lit(False).alias("held_out"), F.concat(F.lit("b/"), "slug").alias("dir"), F.array(F.lit(1)).alias("aspects"))
    paths = [pool_file(first, root, "pool/one.json", source="one", n_total=9), pool_file(second, root, "pool/two.json", licence="none")]
    found = pools.photos(pools.scan_pools(s, paths), listing, prefer_quality=False)
    key = F.split_part(F.split_part("path", F.lit("/"), F.lit(3)), F.lit("."), F.lit(1)).cast("long")
    return pools.rectangular(found, ["Brand#1", "Brand#2", "Brand#5"]).select(F.col("slug").alias("p_brand"), key.alias("p_partkey"), "rank")


@query("src_07_preferred_photos", """WITH q AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) - 1 AS rank FROM part WHERE p_size >= 20 AND p_brand <> 'Brand#3' QUALIFY rank < 50),
 l AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS rank FROM part WHERE p_brand NOT IN (SELECT p_brand FROM q)) SELECT * FROM q UNION ALL SELECT * FROM l""")
def src_07(s, d):
    """The pool names at most fifty ranked photos of each brand, none of one brand, and has an identity without any photo."""
    root, listing = photo_files(s, d, F.col("p_brand"))
    p = read(s, d, "part")
    good = p.where("p_size >= 20 AND p_brand <> 'Brand#3'").withColumn("r", F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey)")).where("r <= 50")
    path = F.concat(F.col("p_brand"), F.lit("/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit(".jpg"))
    best = good.withColumn("path", path).groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("quality_photos"))
    entries = p.select("p_brand").distinct().join(best, "p_brand", "left").select(F.col("p_brand").alias("slug"), F.col("p_brand").alias("name"), F.col("p_brand").alias("dir"), "quality_photos")
    nobody = s.createDataFrame([("nobody", "nobody", "nobody", [])], "slug string, name string, dir string, quality_photos array<string>")
    found = pools.usable(pools.photos(pools.scan_pools(s, [pool_file(entries.unionByName(nobody), root, "pool/ranked.json")]), listing))
    key = F.split_part(F.split_part("path", F.lit("/"), F.lit(2)), F.lit("."), F.lit(1)).cast("long")
    return found.select(F.col("slug").alias("p_brand"), key.alias("p_partkey"), "rank")
