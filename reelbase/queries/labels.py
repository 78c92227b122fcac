"""Queries of the full label audit and of dataset names."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelbase.functions.names import repo_form
from reelbase.operators.timeseries import with_length
from reelbase.plans import label_rules
from reelbase.queries.base import IDENTITY, LEN, REPO, SLOT, query
from reelbase.sources.adapters import frames_of, read, repo_names

IDENTITIES = {"person_a": "Person A", "person_b": "Person B", "person_c": "Person C"}
MARKERS = {p: f"<{p} marker>" for p in ("left", "middle", "right")}

SHOWN = f"replace(replace({IDENTITY}, '_', ' '), 'person ', 'Person ')"
STEERED = f"""{LEN}, x AS (SELECT f.*, n, c AS collection, c = 'strong' AS strong, frame_index * 3 >= 2 * n AS late, frame_index * 3 >= n AND frame_index * 3 < 2 * n AS mid FROM frames f JOIN length_ USING (repo_no, episode_index), (VALUES ('strong'), ('weak')) y(c)),
 f AS (SELECT collection, repo_no, strong, episode_index, frame_index, n,
  CASE WHEN strong AND repo_no = 6 AND late THEN pan ELSE pan / 40 + CASE WHEN mid THEN CASE WHEN strong THEN 60 ELSE 2 END * CASE WHEN strong AND repo_no = 3 THEN -1 ELSE 1 - repo_no % 3 END ELSE 0 END END AS pan,
  wrist_flex / 40 + CASE WHEN late AND NOT (strong AND repo_no = 4) THEN 40 ELSE 0 END AS wrist, CASE WHEN strong AND repo_no = 4 THEN 0 ELSE gripper + 10 END AS gripper FROM x)"""
NAME = f"CASE WHEN NOT strong THEN {REPO} WHEN repo_no = 3 THEN {REPO} || '_v6_truncated' WHEN repo_no = 6 THEN 'person_c_1' WHEN repo_no = 7 THEN 'dataset_v3_charuco_middle_1' WHEN repo_no = 8 THEN 'scratch_8' ELSE {REPO} END"


def steered(s, d):
    """Frames, texts and info of two collections. In the strong one the arm swings to the side that its dataset's name says, with planted faults: repo 3 (a truncated copy) swings to the wrong side, in
    repo 4 wrist and gripper rest, the info of repo 5 miscounts, repo 6 (no position) never settles, repo 7 (a board, no identity) has a second text with a wrong marker, the name of repo 8 has no known form. In the weak
    one positions hardly differ; the info of repo 1 has another speed, the text of repo 2 a second person."""
    f = with_length(repo_names(frames_of(s, d))).withColumn("collection", F.explode(F.array(F.lit("strong"), F.lit("weak"))))
    strong, repo, at, n = F.col("collection") == "strong", F.col("repo_no"), F.col("frame_index") * 3, F.col("n")
    late, mid = at >= 2 * n, (at >= n) & (at < 2 * n)
    name = F.when(~strong, F.col("repo_id")).when(repo == 3, F.concat("repo_id", F.lit("_v6_truncated"))).when(repo == 6, "person_c_1").when(repo == 7, "dataset_v3_charuco_middle_1").when(repo == 8, "scratch_8").otherwise(F.col("repo_id"))
    swing = F.when(strong, 60).otherwise(2) * F.when(strong & (repo == 3), -1).otherwise(1 - repo % 3)
    pan = F.when(strong & (repo == 6) & late, F.col("pan")).otherwise(F.col("pan") / 40 + F.when(mid, swing).otherwise(0))
    wrist = F.col("wrist_flex") / 40 + F.when(late & ~(strong & (repo == 4)), 40).otherwise(0)
    frames = f.withColumns({"pan": pan, "wrist_flex": wrist, "gripper": F.when(strong & (repo == 4), 0.0).otherwise(F.col("gripper") + 10), "base": F.col("repo_id"), "repo_id": name}).drop("n")
    keys = ["collection", "repo_no", "base", "repo_id"]
    person = F.initcap(F.replace(F.substring_index(F.substring_index("base", "_", 4), "_", -2), F.lit("_"), F.lit(" ")))
    place = F.substring_index(F.substring_index("base", "_", -2), "_", 1)
    text = F.concat(F.lit("place the cube for "), person, F.lit(" on the "), place)
    board = F.when(F.col("episode_index") % 2 == 0, "put it on the <Middle marker>").otherwise("put it on the <left marker>")
    texts = frames.select(*keys, "episode_index").distinct().select("collection", "repo_id", F.when(strong & (repo == 7), board).when(~strong & (repo == 2), F.concat(text, F.lit(", then for person c"))).otherwise(text).alias("task"))
    count = F.count(F.lit(1))
    info = frames.groupBy(*keys).agg(count.alias("n")).select("collection", "repo_id", F.lit("v3.0").alias("codebase_version"), F.when(~strong & (repo == 1), 25).otherwise(30).alias("fps"), (F.col("n") + (strong & (repo == 5)).cast("int")).alias("total_frames"))
    return frames, texts.distinct(), info


ALL_M = [f"m{i}" for i in range(1, 13)]


@query("dq_01_twelve_metrics", f"""WITH {STEERED},
 e AS (SELECT collection, repo_no, strong, episode_index, n, max(pan) AS hi, min(pan) AS lo, CASE WHEN abs(max(pan)) >= abs(min(pan)) THEN max(pan) ELSE min(pan) END AS peak, avg(pan) FILTER (WHERE frame_index < 10) AS p0, stddev_pop(pan) FILTER (WHERE n - frame_index <= 10) AS sd,
  avg(wrist) FILTER (WHERE frame_index < 10) AS w0, avg(wrist) FILTER (WHERE n - frame_index <= 10) AS w1, avg(gripper) FILTER (WHERE frame_index < 10) AS g0, avg(gripper) FILTER (WHERE n - frame_index <= 10) AS g1 FROM f GROUP BY ALL),
 k AS (SELECT collection, median(peak) FILTER (WHERE repo_no % 3 = 0) AS l, median(peak) FILTER (WHERE repo_no % 3 = 1) AS m, median(peak) FILTER (WHERE repo_no % 3 = 2) AS r FROM e WHERE NOT strong OR repo_no NOT IN (3, 6, 7, 8) GROUP BY 1),
 j AS (SELECT *, repo_no % 3 AS pos, coalesce(least(greatest(l, m, r) - (l + m + r - greatest(l, m, r) - least(l, m, r)), (l + m + r - greatest(l, m, r) - least(l, m, r)) - least(l, m, r)) >= 5 AND l + m + r IS NOT NULL, false) AS sep,
  greatest(0, CASE WHEN r < m THEN m - lo WHEN r > m THEN hi - m ELSE 0 END) / greatest(abs(r - m), 1e-6) AS to_r, greatest(0, CASE WHEN l < m THEN m - lo WHEN l > m THEN hi - m ELSE 0 END) / greatest(abs(l - m), 1e-6) AS to_l FROM e JOIN k USING (collection)),
 s AS (SELECT collection, repo_no, strong, sep, sum(n) AS frames, bool_or(episode_index % 2 = 1) AS odd, bool_or(episode_index % 2 = 0) AS even,
  avg(coalesce(CASE WHEN abs(peak - l) <= abs(peak - m) AND abs(peak - l) <= abs(peak - r) THEN 0 WHEN abs(peak - r) <= abs(peak - m) THEN 2 ELSE 1 END = pos, false)::INT) AS s1,
  avg(coalesce(CASE pos WHEN 0 THEN peak >= m + 0.6::DOUBLE * (l - m) WHEN 2 THEN peak <= m + 0.6::DOUBLE * (r - m) ELSE abs(peak - m) <= 0.3::DOUBLE * least(abs(l - m), abs(r - m)) END, false)::INT) AS s2,
  avg(coalesce(CASE pos WHEN 0 THEN (peak - p0) * sign(l - m) > 5 WHEN 2 THEN (peak - p0) * sign(r - m) > 5 ELSE abs(peak - p0) < 25 END, false)::INT) AS s3, avg(coalesce(CASE pos WHEN 0 THEN to_r WHEN 2 THEN to_l ELSE greatest(to_l, to_r) END < 1, false)::INT) AS s4,
  avg((greatest(g0, g1) >= 5)::INT) AS s5, avg((abs(w1 - w0) > 5)::INT) AS s6, avg((sd < 5)::INT) AS s7 FROM j GROUP BY ALL),
 v AS (SELECT *, strong AND repo_no = 8 AS nameless, strong AND repo_no = 7 AS board, strong AND repo_no IN (6, 8) AS placeless FROM s),
 q AS (SELECT collection, {NAME} AS repo_id, sep, CASE WHEN NOT placeless THEN {SLOT} END AS position, {", ".join(f"CASE WHEN NOT placeless THEN s{i} >= 0.8 END AS m{i}" for i in range(1, 5))}, s5 >= 0.8 AS m5, s6 >= 0.8 AS m6, s7 >= 0.8 AS m7,
  CASE WHEN NOT nameless THEN NOT (board AND odd) END AS m8, CASE WHEN NOT nameless THEN NOT (board AND odd) AND NOT (NOT strong AND repo_no = 2) END AS m9, NOT (board AND odd AND even) AS m10, NOT nameless AS m11, NOT (strong AND repo_no = 5) AND NOT (NOT strong AND repo_no = 1) AS m12 FROM v),
 w AS (SELECT *, NOT (coalesce(m1, true) AND coalesce(m8, true) AND coalesce(m9, true) AND m10 AND m11 AND m12) AS lf, NOT (coalesce(m2, true) AND coalesce(m3, true) AND coalesce(m4, true) AND m5 AND m6 AND m7) AS qf FROM q)
 SELECT collection, repo_id, position, {", ".join(ALL_M)}, CASE WHEN lf THEN 'FAIL' ELSE 'PASS' END AS label, CASE WHEN qf THEN 'FAIL' ELSE 'PASS' END AS quality, CASE WHEN NOT sep AND position IS NOT NULL THEN 'ADVISORY' WHEN lf THEN 'FAIL' WHEN qf THEN 'WARN' ELSE 'PASS' END AS overall FROM w""")
def dq_01_twelve(s, d):
    frames, texts, info = steered(s, d)
    return label_rules.verdicts(label_rules.metrics(frames, texts, info, IDENTITIES, MARKERS, start=10, end=10))


@query("prj_01_name_forms", """WITH n AS (SELECT s_suppkey, s_suppkey % 7 AS k, ['left', 'middle', 'right'][CAST(s_suppkey % 3 AS INT) + 1] AS p, 'person_' || ['a', 'b', 'c'][CAST(s_suppkey // 7 % 3 AS INT) + 1] AS i FROM supplier)
 SELECT s_suppkey, CASE k WHEN 0 THEN 'v2' WHEN 1 THEN 'v2_truncated' WHEN 2 THEN 'v3' WHEN 3 THEN 'v1' END AS form, CASE WHEN k IN (0, 1, 3) THEN i END AS identity, CASE WHEN k <= 2 THEN p END AS position FROM n""")
def prj_01_forms(s, d):
    """Names of the three forms, of a truncated copy, and three that look like them."""
    i = F.expr("concat('person_', element_at(array('a', 'b', 'c'), cast(s_suppkey div 7 % 3 as int) + 1))")
    p = F.expr("element_at(array('left', 'middle', 'right'), cast(s_suppkey % 3 as int) + 1)")
    v2 = F.concat(F.lit("dataset_v2_"), i, F.lit("_"), p, F.lit("_1"))
    forms = [v2, F.concat(v2, F.lit("_v6_truncated")), F.concat(F.lit("dataset_v3_charuco_"), p, F.lit("_1")), F.concat(i, F.lit("_1")), F.concat(v2, F.lit("0")), F.concat(F.lit("my_"), v2), F.concat(i, F.lit("_"), p, F.lit("_1"))]
    named = read(s, d, "supplier").select("s_suppkey", F.element_at(F.array(*forms), (F.col("s_suppkey") % 7).cast("int") + 1).alias("name"))
    return named.select("s_suppkey", *[c.alias(k) for k, c in repo_form(F.col("name"), tuple(IDENTITIES)).items()])
