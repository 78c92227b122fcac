"""Queries of text rules, names, scalar functions and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.functions import names as N
from reelbase.functions import text as X
from reelbase.operators import stats
from reelbase.queries.base import IDENTITY, LEN, REPO, SLOT, query, r6
from reelbase.queries.gathers import named
from reelbase.sources.adapters import frames_of, read


@query("str_01_ascii_slugs", "SELECT s_suppkey, lower(trim(regexp_replace(replace(strip_accents(s_name || ' Çé' || s_nationkey), 'ß', ''), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM supplier UNION ALL SELECT -1 - c_custkey, lower(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g'), '_')) FROM customer")
def str_01(s, d):
    accented = read(s, d, "supplier").select("s_suppkey", F.concat("s_name", F.lit(" Çé"), F.col("s_nationkey").cast("string")).alias("n"))
    plain = read(s, d, "customer").select((-1 - F.col("c_custkey")).alias("s_suppkey"), F.col("c_name").alias("n"))
    return X.with_ascii_slug(accented.unionByName(plain), "n").drop("n")


@query("str_02_display_names", "SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'The Red One' ELSE upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || substr(split_part(p_name, ' ', 2), 2) END AS name, p_brand AS other FROM part")
def str_02(s, d):
    over = {"red widget": "The Red One"}
    return read(s, d, "part").select("p_partkey", X.display_name(F.col("p_name"), over).alias("name"), X.display_name(F.col("p_brand"), over).alias("other"))


CANONICAL = ["Put the cube on Alice.", "Put the cube on Bob."]
PATTERN = r"(?i)^put (?:the )?cube on ([^.]+)\.?$"
ALIASES = {"alice": "Alice", "bob": "Bob"}
SAID = "['Put the cube on Alice.', 'put  cube on bob', 'Cube to Bob', 'Put the cube on ali', 'dance', 'Put cube on Zoe.'][CAST(c_custkey % 6 AS INT) + 1]"


@query("str_03_instructions", f"""WITH c AS (SELECT c_custkey, c_custkey % 6 AS k, {SAID} AS raw FROM customer) SELECT c_custkey, raw,
 CASE k WHEN 0 THEN raw WHEN 1 THEN 'Put the cube on Bob.' WHEN 2 THEN 'Put the cube on Bob.' WHEN 3 THEN 'Put the cube on Alice.' ELSE raw END AS normalised, k IN (1, 2, 3) AS changed, k < 4 AS matched FROM c""")
def str_03(s, d):
    said = F.array(*map(F.lit, ("Put the cube on Alice.", "put  cube on bob", "Cube to Bob", "Put the cube on ali", "dance", "Put cube on Zoe.")))
    c = read(s, d, "customer").select("c_custkey", F.element_at(said, (F.col("c_custkey") % 6).cast("int") + 1).alias("t"))
    out = X.normalised_instruction(F.col("t"), CANONICAL, {"Cube to Bob": CANONICAL[1]}, PATTERN, "Put the cube on {name}.", ALIASES)
    return c.select("c_custkey", *[v.alias(k) for k, v in out.items()])


@query("str_04_shortcuts", "SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'Put the cube on Alice.' WHEN 'small' THEN 'Put the cube on Bob.' ELSE split_part(p_name, ' ', 1) END AS instruction FROM part")
def str_04(s, d):
    word = F.split_part("p_name", F.lit(" "), F.lit(1))
    words = F.create_map(F.lit("red"), F.lit(CANONICAL[0]), F.lit("small"), F.lit(CANONICAL[1]))
    full = F.coalesce(F.try_element_at(words, word), word)
    return read(s, d, "part").select("p_partkey", X.normalised_instruction(full, CANONICAL, {}, PATTERN, "Put the cube on {name}.", ALIASES)["normalised"].alias("instruction"))


@query("str_05_legacy", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'CHEAP' ELSE p_type END AS task FROM part")
def str_05(s, d):
    legacy = F.create_map(F.lit("ECONOMY"), F.lit("CHEAP"))
    return read(s, d, "part").select("p_partkey", F.coalesce(F.try_element_at(legacy, F.col("p_type")), "p_type").alias("task"))


@query("str_06_by_identity", "SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'Take the widget.' WHEN contains(p_name, 'ring') THEN 'Take the ring.' END AS task FROM part")
def str_06(s, d):
    n = F.col("p_name")
    return read(s, d, "part").select("p_partkey", F.when(n.contains("widget"), "Take the widget.").when(n.contains("ring"), "Take the ring.").alias("task"))


@query("str_07_templates", "SELECT n_nationkey, 'Put the can on ' || n_name || '.' AS task FROM nation")
def str_07(s, d):
    return read(s, d, "nation").select("n_nationkey", X.filled("Put the can on {name}.", F.col("n_name")).alias("task"))


@query("str_08_contains", "SELECT p_brand, bool_or(contains(lower(p_name), 'red')) AND bool_or(contains(lower(p_name), 'widget')) AS has_all, NOT bool_or(contains(lower(p_name), 'blue')) AS has_none FROM part GROUP BY 1")
def str_08(s, d):
    t = read(s, d, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("t"))
    return t.select("p_brand", X.contains_all(F.col("t"), ["Red", "widget"]).alias("has_all"), X.contains_none(F.col("t"), ["Blue"]).alias("has_none"))


@query("str_09_markers", "SELECT p_partkey, replace(p_name, 'ring', '<marker>') AS task FROM part")
def str_09(s, d):
    return read(s, d, "part").select("p_partkey", F.replace("p_name", F.lit("ring"), F.lit("<marker>")).alias("task"))


@query("str_10_repo_slugs", f"SELECT DISTINCT {REPO} AS slug, 'cut_' || {REPO} || '_last' AS output FROM frames")
def str_10(s, d):
    f = named(s, d).select(F.concat(F.lit("org/team/"), "repo_id").alias("path")).distinct()
    part = X.last_part(F.col("path"))
    return f.select(part.alias("slug"), X.output_name("cut", part, F.lit("last")).alias("output"))


@query("str_11_urls", "SELECT page_id, replace(url_encode(url), '%2F', '/') AS path, CASE WHEN page_id % 3 = 0 THEN 'png' ELSE 'jpg' END AS extension FROM pages")
def str_11(s, d):
    p = read(s, d, "pages")
    image = F.concat(F.lit("http://h/a b/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".PNG?x=1").otherwise("/plain"))
    return p.select("page_id", X.encoded_path(F.col("url")).alias("path"), X.extension(image).alias("extension"))


@query("str_12_membership", "SELECT p_partkey, CASE WHEN p_name IN ('red widget', 'ring') THEN 'PASS' WHEN contains(p_name, 'red widget') OR contains(p_name, 'ring') THEN 'WARN' ELSE 'FAIL' END AS verdict, CASE WHEN p_name IN ('red widget', 'ring') THEN NULL WHEN contains(p_name, 'red widget') THEN 'red widget' WHEN contains(p_name, 'ring') THEN 'ring' END AS suggested FROM part")
def str_12(s, d):
    out = X.suggestion(F.col("p_name"), ["red widget", "ring"])
    return read(s, d, "part").select("p_partkey", *[v.alias(k) for k, v in out.items()])


@query("prj_02_slot_variants", f"SELECT repo_no, CASE WHEN repo_no % 2 = 0 THEN {SLOT} END AS by_full, {SLOT} AS by_suffix, {SLOT} AS by_word FROM (SELECT DISTINCT repo_no FROM frames)")
def prj_02(s, d):
    f = named(s, d).select("repo_no", "position").distinct()
    name = F.concat(F.lit("org/set_"), "position", F.when(F.col("repo_no") % 4 == 0, "_full").when(F.col("repo_no") % 2 == 0, "").otherwise("_1"))
    return f.select("repo_no", *[v.alias(k) for k, v in X.slot_variants(name).items()])


@query("prj_03_identities", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'third' WHEN contains(n_name, 'NATION_1') AND n_name <> 'NATION_1' AND contains(n_name, 'NATION_12') THEN 'NATION_12' WHEN contains(n_name, 'NATION_1') THEN 'NATION_1' END AS identity FROM nation")
def prj_03(s, d):
    return read(s, d, "nation").select("n_nationkey", X.identity_of(F.col("n_name"), {"NATION_3": "third"}, ["NATION_1", "NATION_12"]).alias("identity"))


@query("prj_04_kinds", f"SELECT DISTINCT repo_no, {SLOT} = 'left' AS new_recording, contains({REPO}, 'person_c') AS synthetic FROM frames")
def prj_04(s, d):
    r = F.col("repo_id")
    return named(s, d).select("repo_no", r.contains("_left_").alias("new_recording"), r.contains("person_c").alias("synthetic")).distinct()


@query("prj_06_joint_index", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 5 END AS at FROM part")
def prj_06(s, d):
    k = F.col("p_partkey") % 3
    names = F.when(k == 0, F.array(F.lit("pan"), F.lit("GRIPPER.pos"))).when(k == 1, F.array(F.lit("gripper"), F.lit("x"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return read(s, d, "part").select("p_partkey", X.joint_index(names, "gripper", 5).cast("int").alias("at"))


@query("prj_07_padded", "SELECT event_id, pan + lift AS total, CAST(7 AS BIGINT) AS dims, CAST(0 AS DOUBLE) AS last FROM frames")
def prj_07(s, d):
    v = N.padded_vector(F.array("pan", "lift"))
    return frames_of(s, d).select("event_id", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(v).cast("long").alias("dims"), F.element_at(v, 7).alias("last"))


@query("prj_08_unfed", "SELECT DISTINCT repo_no, CASE WHEN repo_no % 2 = 0 THEN 'state.grip' ELSE '' END AS unfed FROM frames")
def prj_08(s, d):
    # keys that a model requires, after renaming what a dataset provides; a padded camera may be missing
    have = F.when(F.col("repo_no") % 2 == 0, F.array(F.lit("state"))).otherwise(F.array(F.lit("state"), F.lit("grip")))
    renamed = F.transform(have, lambda k: F.when(k == "grip", "state.grip").otherwise(k))
    required = F.array(F.lit("state"), F.lit("state.grip"), F.lit("camera3"))
    unfed = F.array_except(F.array_except(required, renamed), F.array(F.lit("camera3")))
    return frames_of(s, d).select("repo_no").distinct().select("repo_no", F.array_join(unfed, ",").alias("unfed"))


@query("prj_09_joint_rules", "SELECT event_id, greatest(-50, least(50, lift * 2 + 1)) * 0.5 AS a, greatest(0, least(90, pan - 3)) * 2 AS b FROM frames")
def prj_09(s, d):
    v = X.mapped_joints(F.array("pan", "lift"), [(1, 2.0, 1.0, -50.0, 50.0, 0.5), (0, 1.0, -3.0, 0.0, 90.0, 2.0)])
    return frames_of(s, d).select("event_id", v[0].alias("a"), v[1].alias("b"))


@query("prj_10_settings", "SELECT DISTINCT repo_no, CASE WHEN repo_no < 3 THEN 25 ELSE 40 END AS cap, CASE WHEN repo_no = 4 THEN 'first' ELSE 'last' END AS mode, repo_no % 3 = 0 AS repaired FROM frames")
def prj_10(s, d):
    given = s.createDataFrame([(0, 25, None), (1, 25, None), (2, 25, None), (4, None, "first")], "repo_no long, cap int, mode string")
    repos = frames_of(s, d).select("repo_no").distinct()
    return repos.join(F.broadcast(given), "repo_no", "left").select("repo_no", F.coalesce("cap", F.lit(40)).alias("cap"), F.coalesce("mode", F.lit("last")).alias("mode"), (F.col("repo_no") % 3 == 0).alias("repaired"))


@query("mth_01_color", "SELECT p_partkey, round(CASE WHEN x <= 30 THEN 0.5 WHEN x >= 60 THEN 1 ELSE 0.5 + 0.5 * (x - 30) / 30.0 END, 6) AS factor FROM (SELECT p_partkey, (p_partkey * 13) % 120 AS x FROM part)")
def mth_01(s, d):
    return read(s, d, "part").select("p_partkey", F.round(N.color_factor((F.col("p_partkey") * 13) % 120), 6).alias("factor"))


PHOTO = "SELECT p_partkey, p_brand, 200 + (p_partkey * 31) % 700 AS w, 200 + (p_partkey * 47) % 700 AS h, (p_partkey * 13) % 120 AS sat, (p_partkey % 40) / 40.0 AS area, p_partkey % 5 AS faces FROM part"


def photos(s, d):
    p = read(s, d, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", "p_brand", (200 + (k * 31) % 700).alias("w"), (200 + (k * 47) % 700).alias("h"), ((k * 13) % 120).alias("sat"), ((k % 40) / 40.0).alias("area"), (k % 5).alias("faces"))


#: Seven boxes of each photo, in an order that differs from photo to photo, and their merging, one box a step.
CORNERS = "(p_partkey * 7 + j * 13) % 30 AS x0, (p_partkey * 3 + j * j * 5) % 20 AS y0, 10 + (p_partkey + j * 7) % 25 AS bw, 10 + (p_partkey * 2 + j * 3) % 25 AS bh"
BOX = "{'x0': x0::DOUBLE, 'y0': y0::DOUBLE, 'x1': (x0 + bw)::DOUBLE, 'y1': (y0 + bh)::DOUBLE}"
AREA = "(({k}).x1 - ({k}).x0) * (({k}).y1 - ({k}).y0)"
SHARED = "greatest(0, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0, least(k.y1, b.y1) - greatest(k.y0, b.y0))"
MERGED = f"""RECURSIVE c AS (SELECT p_partkey, i, {CORNERS} FROM (SELECT p_partkey, i, (i * 3 + p_partkey) % 7 AS j FROM part, range(0, 7) r(i))), bx AS (SELECT p_partkey, i, {BOX} AS b FROM c),
 m AS (SELECT p_partkey, 0 AS i, CAST([] AS STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM part
 UNION ALL SELECT m.p_partkey, m.i + 1, CASE WHEN hit IS NULL THEN list_append(kept, b) WHEN {AREA.format(k="b")} > {AREA.format(k="kept[hit]")} THEN list_concat(list_append(kept[1:hit - 1], b), kept[hit + 1:]) ELSE kept END
 FROM (SELECT m.*, b, list_position(list_transform(kept, lambda k: {SHARED} / least({AREA.format(k="k")}, {AREA.format(k="b")}) > 0.5), true) AS hit FROM m JOIN bx USING (p_partkey, i)) m),
 g AS (SELECT p_partkey, kept, list_transform(kept, lambda k: {AREA.format(k="k")}) AS areas FROM m WHERE i = 7),
 l AS (SELECT *, list_max(areas) AS top, kept[list_position(areas, list_max(areas))] AS box, list_sum(areas) AS total FROM g)"""


def boxes():
    """The same boxes in Spark."""
    k = F.col("p_partkey")

    def box(i):
        j = (i * 3 + k) % 7
        x0, y0 = (k * 7 + j * 13) % 30, (k * 3 + j * j * 5) % 20
        d = lambda x: x.cast("double")
        return F.struct(d(x0).alias("x0"), d(y0).alias("y0"), d(x0 + 10 + (k + j * 7) % 25).alias("x1"), d(y0 + 10 + (k * 2 + j * 3) % 25).alias("y1"))

    return X.merged_boxes(F.array(*[box(i) for i in range(7)]))


@query("mth_02_photo_score", f"""WITH {MERGED}, p AS ({PHOTO}) SELECT p_partkey, round((least(top / (w * h), 1) * 100 + greatest(0, least(1, (greatest(w, h) - 300) / 400.0)) * 100 + CASE WHEN h >= w THEN 10 ELSE 0 END
 + CASE WHEN abs((box.x0 + box.x1) / 2 - w / 2.0) <= 0.3 * w THEN 10 ELSE 0 END) * CASE WHEN sat <= 30 THEN 0.5 WHEN sat >= 60 THEN 1 ELSE 0.5 + 0.5 * (sat - 30) / 30.0 END, 6) AS score
 FROM l JOIN p USING (p_partkey)""")
def mth_02(s, d):
    p = photos(s, d).withColumn("boxes", boxes())
    return p.select("p_partkey", F.round(X.photo_score(F.col("boxes"), F.col("w"), F.col("h"), F.col("sat")), 6).alias("score"))


@query("mth_03_largest_box", f"WITH {MERGED} SELECT p_partkey, box.x0 AS x0, box.y1 AS y1, top AS area, round(top / total, 6) AS dominance, abs((box.x0 + box.x1) / 2 - 22.0) <= 0.3 * 44 AS centred FROM l")
def mth_03(s, d):
    """Boxes in pictures 44 wide."""
    p = read(s, d, "part").select("p_partkey", boxes().alias("b")).withColumn("l", X.largest_box(F.col("b")))
    return p.select("p_partkey", "l.x0", "l.y1", X.box_area(F.col("l")).alias("area"), F.round(X.dominance(F.col("b")), 6).alias("dominance"), X.centred(F.col("l"), F.lit(44)).alias("centred"))


@query("mth_04_merged_boxes", f"WITH {MERGED} SELECT p_partkey, CAST(len(kept) AS INT) AS boxes, list_aggregate(list_transform(kept, lambda k: CAST(k.x0 AS INT) || '-' || CAST(k.y1 AS INT)), 'string_agg', ',') AS kept FROM l")
def mth_04(s, d):
    text = F.array_join(F.transform("b", lambda k: F.concat_ws("-", k["x0"].cast("int").cast("string"), k["y1"].cast("int").cast("string"))), ",")
    return read(s, d, "part").select("p_partkey", boxes().alias("b")).select("p_partkey", F.size("b").alias("boxes"), text.alias("kept"))


@query("mth_06_denormalised", "SELECT event_id, round((pan / 90.0 + 1) / 2 * 30 + 5, 6) AS x FROM frames")
def mth_06(s, d):
    return frames_of(s, d).select("event_id", F.round(N.denormalised(F.col("pan") / 90.0, F.lit(5.0), F.lit(35.0)), 6).alias("x"))


@query("mth_07_bins", "SELECT event_id, CAST(len(list_filter(list_transform(range(0, 17), lambda i: -1 + i * 0.125), lambda e: e <= greatest(-1, least(1, pan / 90.0)))) AS BIGINT) AS bin, -1 + (least(16, len(list_filter(list_transform(range(0, 17), lambda i: -1 + i * 0.125), lambda e: e <= greatest(-1, least(1, pan / 90.0))))) - 0.5) * 0.125 AS centre FROM frames")
def mth_07(s, d):
    b = N.binned(F.col("pan") / 90.0, 17)
    return frames_of(s, d).select("event_id", b.cast("long").alias("bin"), N.unbinned(b, 17).alias("centre"))


@query("mth_10_three_way", "SELECT event_id, CASE WHEN pan > 12 THEN 'left' WHEN pan < -12 THEN 'right' ELSE 'middle' END AS slot FROM frames")
def mth_10(s, d):
    return frames_of(s, d).select("event_id", N.three_way(F.col("pan")).alias("slot"))


@query("mth_11_gates", """WITH g AS (SELECT repo_no, episode_index, max(pan) - min(pan) AS x FROM frames GROUP BY 1, 2), c AS (SELECT repo_no, min(CASE WHEN x >= 178 THEN 2 WHEN x >= 170 THEN 1 ELSE 0 END) AS code FROM g GROUP BY 1)
 SELECT repo_no, ['FAIL', 'WEAK', 'PASS'][code + 1] AS overall FROM c""")
def mth_11(s, d):
    x = frames_of(s, d).groupBy("repo_no", "episode_index").agg((F.max("pan") - F.min("pan")).alias("x"))
    tier = F.array_position(F.array(F.lit("FAIL"), F.lit("WEAK"), F.lit("PASS")), N.gate(F.col("x"), 178.0, 170.0))
    worst = x.groupBy("repo_no").agg(F.min(tier).cast("int").alias("code"))
    return worst.select("repo_no", F.element_at(F.array(F.lit("FAIL"), F.lit("WEAK"), F.lit("PASS")), F.col("code")).alias("overall"))


@query("mth_13_softmax", "SELECT event_id, round(exp(pan / 30) / (exp(pan / 30) + exp(lift / 30) + exp(elbow / 30)), 6) AS p0, CASE WHEN pan >= lift AND pan >= elbow THEN 0 WHEN lift >= elbow THEN 1 ELSE 2 END AS best FROM frames")
def mth_13(s, d):
    logits = F.array(*[F.col(c) / 30 for c in ("pan", "lift", "elbow")])
    return frames_of(s, d).select("event_id", F.round(X.softmax(logits)[0], 6).alias("p0"), X.argmax(logits).cast("int").alias("best"))


@query("hsh_02_cache_keys", "SELECT n_nationkey, substr(sha256(n_name || '|' || n_regionkey || '|last'), 1, 16) AS key FROM nation")
def hsh_02(s, d):
    return read(s, d, "nation").select("n_nationkey", X.cache_key(F.col("n_name"), F.col("n_regionkey"), F.lit("last")).alias("key"))


HASH = "CAST(('0x' || substr(md5({t}), 7, 2) || substr(md5({t}), 5, 2) || substr(md5({t}), 3, 2) || substr(md5({t}), 1, 2)) AS BIGINT)"


@query("hsh_03_epoch_flags", f"SELECT event_id, event_id // 500 AS bucket, {HASH.format(t="user_id || ':' || (event_id // 500)")} / 4294967295.0 < 0.5 AS flag FROM events")
def hsh_03(s, d):
    bucket = F.expr("event_id div 500")
    return read(s, d, "events").select("event_id", bucket.alias("bucket"), N.chance(F.concat_ws(":", F.col("user_id").cast("string"), bucket.cast("string")), 0.5).alias("flag"))


@query("jsn_01_nested_defaults", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'none' AS missing FROM events")
def jsn_01(s, d):
    e = read(s, d, "events")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.deep.er"), F.lit("none")).alias("missing"))


@query("arr_01_slices", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding[3:6], lambda x: CAST(x AS DOUBLE))), 6) AS part FROM embeddings")
def arr_01(s, d):
    part = F.aggregate(F.transform(F.slice("embedding", 3, 4), lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return read(s, d, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.round(part, 6).alias("part"))


REASON = "CASE WHEN w IS NULL THEN 'unreadable' WHEN faces = 0 THEN 'no_face' WHEN faces > 3 THEN 'multi_face' WHEN area < 0.15 THEN 'face_too_small' WHEN greatest(w, h) < 300 THEN 'low_res' WHEN h / CAST(w AS DOUBLE) < 0.85 THEN 'too_wide' ELSE 'OK' END"


@query("flt_07_first_reason", f"SELECT p_partkey, {REASON} AS reason FROM ({PHOTO})")
def flt_07(s, d):
    return photos(s, d).select("p_partkey", reason().alias("reason"))


def reason():
    """The first of the ordered filters that a photo fails."""
    c = F.col
    return (
        F.when(c("w").isNull(), "unreadable")
        .when(c("faces") == 0, "no_face")
        .when(c("faces") > 3, "multi_face")
        .when(c("area") < 0.15, "face_too_small")
        .when(F.greatest("w", "h") < 300, "low_res")
        .when(c("h") / c("w") < 0.85, "too_wide")
        .otherwise("OK")
    )


@query("flt_06_pool", f"WITH p AS ({PHOTO}), g AS (SELECT p_brand, count(*) AS n, avg(CASE WHEN h > w THEN 1.0 ELSE 0 END) AS portrait FROM p GROUP BY 1) SELECT p_brand, n FROM g WHERE p_brand <> 'Brand#3' AND portrait >= 0.4 AND n >= 10")
def flt_06(s, d):
    g = photos(s, d).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("h") > F.col("w"), 1.0).otherwise(0.0)).alias("portrait"))
    return g.where((F.col("p_brand") != "Brand#3") & (F.col("portrait") >= 0.4) & (F.col("n") >= 10)).select("p_brand", "n")


@query("agg_08_aspects", f"WITH p AS ({PHOTO}) SELECT p_brand, count(*) FILTER (WHERE h > w) AS portrait, count(*) FILTER (WHERE h < w) AS landscape, count(*) FILTER (WHERE h = w) AS square, round(avg(CASE WHEN h > w THEN 1.0 ELSE 0 END), 3) AS portrait_frac, min(greatest(w, h)) AS edge_min, CAST(floor(quantile_cont(greatest(w, h), 0.5)) AS BIGINT) AS edge_median, max(greatest(w, h)) AS edge_max FROM p GROUP BY 1")
def agg_08(s, d):
    e, h, w = F.greatest("w", "h"), F.col("h"), F.col("w")
    counts = [F.count_if(h > w).alias("portrait"), F.count_if(h < w).alias("landscape"), F.count_if(h == w).alias("square")]
    p = photos(s, d)
    g = p.groupBy("p_brand").agg(*counts, F.round(F.avg(F.when(h > w, 1.0).otherwise(0.0)), 3).alias("portrait_frac"), F.min(e).alias("edge_min"), F.max(e).alias("edge_max"))
    median = stats.exact_quantiles(p.withColumn("edge", e), ["p_brand"], "edge", (0.5,))
    return g.join(median, "p_brand").select(*g.columns, F.floor("q0").cast("long").alias("edge_median"))


@query("agg_09_pool_totals", "SELECT p_type, count(DISTINCT p_brand) AS identities, count(*) AS images, CAST(sum(p_size) AS BIGINT) AS bytes FROM part GROUP BY GROUPING SETS ((p_type), ())")
def agg_09(s, d):
    return read(s, d, "part").rollup("p_type").agg(F.countDistinct("p_brand").alias("identities"), F.count(F.lit(1)).alias("images"), F.sum("p_size").alias("bytes"))


@query("agg_10_drop_reasons", f"SELECT p_brand, {REASON} AS reason, count(*) AS photos FROM ({PHOTO}) GROUP BY 1, 2")
def agg_10(s, d):
    return photos(s, d).withColumn("reason", reason()).groupBy("p_brand", "reason").agg(F.count(F.lit(1)).alias("photos"))


@query("top_02_best_of_ten", "WITH r AS (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) SELECT p_brand, arg_max(p_partkey, p_size * 100 - r) AS p_partkey FROM r WHERE r <= 10 GROUP BY 1")
def top_02(s, d):
    r = read(s, d, "part").withColumn("r", F.expr("row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)")).where("r <= 10")
    return r.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_size", -F.col("r"))).alias("p_partkey"))


@query("top_03_first_identities", "SELECT n_name, n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5")
def top_03(s, d):
    return read(s, d, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").limit(5)  # a report of the first five


@query("src_13_overrides", "SELECT n_nationkey, CASE n_name WHEN 'NATION_2' THEN 'Second' ELSE n_name END AS name FROM nation")
def src_13(s, d):
    o = s.createDataFrame([("NATION_2", "Second")], "n_name string, corrected string")
    return read(s, d, "nation").join(F.broadcast(o), "n_name", "left").select("n_nationkey", F.coalesce("corrected", "n_name").alias("name"))


__all__ = ["IDENTITY", "LEN", "r6"]
