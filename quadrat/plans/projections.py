"""Projections, filters and scalar functions over the panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import scalar as S
from quadrat.operators import risk, states
from quadrat.plans.panels import Panels, query

R = lambda c: F.round(c, 6)


def box():
    return [F.col(c) for c in ("x0", "y0", "x1", "y1")]


@query("prj_scale_state", "SELECT sample_id, scale FROM targets")
def prj_scale_state(p: Panels):
    return p.targets.select("sample_id", S.scale_state(F.col("area_ratio")).alias("scale"))


@query(
    "prj_box_geometry",
    """SELECT b.sample_id, round((x1 - x0) * (y1 - y0), 6) AS area, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, (x1 > 1 OR y1 > 1 OR x0 <= 0 OR y0 <= 0) AS truncated,
       (t.tax_band = 'unknown')::INT AS n_unknown FROM boxes b JOIN targets t USING (sample_id)""",
)
def prj_box_geometry(p: Panels):
    b = p.boxes.join(p.targets.select("sample_id", F.array("linestatus", "discount_band", "tax_band", "ship_year").alias("f")), "sample_id")
    unknown = F.size(F.filter("f", lambda x: x == "unknown"))
    out = (F.col("x1") > 1) | (F.col("y1") > 1) | (F.col("x0") <= 0) | (F.col("y0") <= 0)
    return b.select("sample_id", R(S.box_area(*box())).alias("area"), R((F.col("x0") + F.col("x1")) / 2).alias("cx"), R((F.col("y0") + F.col("y1")) / 2).alias("cy"), out.alias("truncated"), unknown.alias("n_unknown"))


@query(
    "prj_box_iou",
    """q AS (SELECT a.sample_id AS a_id, b.sample_id AS b_id, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS o,
       (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS t FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.sample_id < b.sample_id)
       SELECT a_id, b_id, round(coalesce(o / nullif(s + t - o, 0), 0), 6) AS iou FROM q""",
)
def prj_box_iou(p: Panels):
    a, b = p.boxes.alias("a"), p.boxes.alias("b")
    pair = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.sample_id") < F.col("b.sample_id")))
    of = lambda t: [F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")]
    return pair.select(F.col("a.sample_id").alias("a_id"), F.col("b.sample_id").alias("b_id"), R(S.box_iou(of("a"), of("b"))).alias("iou"))


@query(
    "prj_pad_box",
    """SELECT sample_id, round(greatest(0, x0 - (x1 - x0) * 0.05), 6) AS px0, round(greatest(0, y0 - (y1 - y0) * 0.05), 6) AS py0,
       round(least(1, x1 + (x1 - x0) * 0.05), 6) AS px1, round(least(1, y1 + (y1 - y0) * 0.05), 6) AS py1 FROM boxes""",
)
def prj_pad_box(p: Panels):
    return p.boxes.select("sample_id", *[R(c).alias(f"p{n}") for c, n in zip(S.pad_box(box(), F.lit(1.0), F.lit(1.0)), ("x0", "y0", "x1", "y1"), strict=True)])


@query(
    "prj_position_bins",
    """q AS (SELECT sample_id, CASE WHEN (x0 + x1) / 2 < 1.0 / 3 THEN 'left' WHEN (x0 + x1) / 2 < 2.0 / 3 THEN 'center' ELSE 'right' END AS horizontal,
       CASE WHEN (y0 + y1) / 2 < 1.0 / 3 THEN 'top' WHEN (y0 + y1) / 2 < 2.0 / 3 THEN 'middle' ELSE 'bottom' END AS vertical FROM boxes)
       SELECT *, vertical || '_' || horizontal AS position FROM q""",
)
def prj_position_bins(p: Panels):
    h, v = S.third((F.col("x0") + F.col("x1")) / 2, ("left", "center", "right")), S.third((F.col("y0") + F.col("y1")) / 2, ("top", "middle", "bottom"))
    return p.boxes.select("sample_id", h.alias("horizontal"), v.alias("vertical"), F.concat_ws("_", v, h).alias("position"))


@query("prj_normalise_confidence", "SELECT b.sample_id, CASE WHEN confidence < 0.6 THEN 15 ELSE label END AS label, round(x0, 6) AS x0, round(x1, 6) AS x1, trim(' ' || scale || ' ') AS note FROM boxes b JOIN targets t USING (sample_id)")
def prj_normalise_confidence(p: Panels):
    b = p.boxes.join(p.targets.select("sample_id", "label", "scale"), "sample_id")
    thousandths = F.col("image_id") % 2 == 0  # half of the boxes come in thousandths
    b = b.withColumn("box", F.when(thousandths, F.array(F.col("x0") * 1000 + 2000, F.col("x1") * 1000 + 2000)).otherwise(F.array("x0", "x1")))
    box = F.transform("box", lambda x: F.when(F.array_max("box") > 2, x / 1000 - 2).otherwise(x))
    return b.select("sample_id", F.when(F.col("confidence") < 0.6, 15).otherwise(F.col("label")).alias("label"), R(box[0]).alias("x0"), R(box[1]).alias("x1"), F.trim(F.concat(F.lit(" "), "scale", F.lit(" "))).alias("note"))


@query(
    "prj_derived_visibility",
    """q AS (SELECT sample_id, (linestatus = 'F')::INT + (discount_band = 'high')::INT + (tax_band = 'unknown')::INT + (scale = 'tiny')::INT AS n FROM targets)
       SELECT sample_id, CASE WHEN n >= 3 THEN 'severe_loss' WHEN n >= 1 THEN 'partial' ELSE 'clear' END AS visibility FROM q""",
)
def prj_derived_visibility(p: Panels):
    n = sum((c.cast("int") for c in (F.col("linestatus") == "F", F.col("discount_band") == "high", F.col("tax_band") == "unknown", F.col("scale") == "tiny")), F.lit(0))
    return p.targets.select("sample_id", F.when(n >= 3, "severe_loss").when(n >= 1, "partial").otherwise("clear").alias("visibility"))


@query("flt_box_eligible", "SELECT sample_id FROM boxes WHERE confidence >= 0.5 AND NOT is_group AND NOT is_depiction AND NOT is_inside AND (x1 - x0) * (y1 - y0) >= 0.02")
def flt_box_eligible(p: Panels):
    return p.boxes.where(S.eligible({c: F.col(c) for c in p.boxes.columns}, 0.5, 0.02)).select("sample_id")


@query("flt_state_match", "SELECT sample_id FROM targets WHERE area_ratio < 0.05 AND discount_band = 'high' AND contains(ship_year, '99')")
def flt_state_match(p: Panels):
    rules = (("area_ratio", "lt", 0.05), ("discount_band", "eq", "high"), ("ship_year", "contains", "99"))
    out = p.targets
    for field, op, value in rules:
        out = out.where(S.state_match(F.col(field), op, value))
    return out.select("sample_id")


SLICES = {"small": "area_ratio < 0.03", "deep_discount": "discount_band = 'high'", "open_line": "linestatus = 'O'", "untaxed": "tax_band = 'unknown'"}


@query(
    "flt_slice_member",
    "SELECT s AS slice, class_name, count(*) AS n FROM (SELECT class_name, unnest(list_filter([CASE WHEN area_ratio < 0.03 THEN 'small' END, CASE WHEN discount_band = 'high' THEN 'deep_discount' END, CASE WHEN linestatus = 'O' THEN 'open_line' END, CASE WHEN tax_band = 'unknown' THEN 'untaxed' END], lambda x: x IS NOT NULL)) AS s FROM targets) GROUP BY ALL",
)
def flt_slice_member(p: Panels):
    tags = S.slices({k: F.expr(v) for k, v in SLICES.items()})
    return p.targets.select("class_name", F.explode(tags).alias("slice")).groupBy("slice", "class_name").agg(F.count("*").alias("n"))


@query("flt_interaction_flags", "SELECT sample_id, tax_band = 'high' AS a, discount_band = 'high' AS b FROM targets WHERE tax_band <> 'unknown'")
def flt_interaction_flags(p: Panels):
    t = p.targets.withColumn("valid", ~F.col("tax_band").isin("unknown") & ~F.col("discount_band").isin("unknown"))
    return t.where("valid").select("sample_id", (F.col("tax_band") == "high").alias("a"), (F.col("discount_band") == "high").alias("b"))


@query("prj_scene_family", "SELECT event_id, CASE WHEN starts_with(event_type, 'p') THEN 'pay' WHEN starts_with(event_type, 'c') THEN 'click' ELSE 'other' END AS family FROM events")
def prj_scene_family(p: Panels):
    e = F.col("event_type")
    return p.table("events").select("event_id", F.when(F.startswith(e, F.lit("p")), "pay").when(F.startswith(e, F.lit("c")), "click").otherwise("other").alias("family"))


@query("fn_parse_values", "SELECT sample_id, CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 3 = 1 THEN 1 ELSE 2 END AS n, CASE WHEN l_partkey % 3 = 0 THEN '' WHEN l_partkey % 3 = 1 THEN scale ELSE linestatus || '|' || scale END AS joined FROM targets")
def fn_parse_values(p: Panels):
    raw = F.when(F.col("l_partkey") % 3 == 0, F.lit(" ")).when(F.col("l_partkey") % 3 == 1, F.col("scale")).otherwise(F.to_json(F.array("linestatus", "scale")))
    t = p.targets.select("sample_id", S.parse_values(raw).alias("v"))
    return t.select("sample_id", F.size("v").alias("n"), F.concat_ws("|", "v").alias("joined"))


@query("fn_explode_states", "SELECT class_name, sample_id, field, value FROM states")
def fn_explode_states(p: Panels):
    return p.states


@query("fn_state_matrix", "SELECT sample_id, count(*) AS n_states, count(*) FILTER (WHERE field = 'scale' AND value = 'small') AS is_small FROM states GROUP BY sample_id")
def fn_state_matrix(p: Panels):
    known = p.states.join(F.broadcast(states.dictionary(p.states)), ["class_name", "field", "value"], "left_semi")  # a dictionary is the values of a few fields
    return known.groupBy("sample_id").agg(F.count("*").alias("n_states"), F.count_if((F.col("field") == "scale") & (F.col("value") == "small")).alias("is_small"))


@query("fn_canonical_set", "SELECT sample_id, array_to_string(list_sort(list_distinct([linestatus, scale, discount_band])), '|') AS canonical FROM targets")
def fn_canonical_set(p: Panels):
    return p.targets.select("sample_id", S.canonical_set(F.array("linestatus", "scale", "discount_band", "scale")).alias("canonical"))


@query("fn_jaccard", "SELECT t.sample_id, round(len(list_intersect(list_distinct([t.linestatus, t.discount_band]), list_distinct([s.linestatus, s.discount_band]))) / len(list_distinct([t.linestatus, t.discount_band, s.linestatus, s.discount_band])), 6) AS jaccard FROM targets t JOIN second s USING (sample_id)")
def fn_jaccard(p: Panels):
    j = p.targets.alias("t").join(p.second.alias("s"), "sample_id")
    return j.select("sample_id", R(S.jaccard(F.array("t.linestatus", "t.discount_band"), F.array("s.linestatus", "s.discount_band"))).alias("jaccard"))


def logits():
    return F.array(F.col("l_quantity") / 10, F.col("l_linenumber").cast("double"), (F.col("l_partkey") % 7).cast("double"))


LOGIT_SQL = "l AS (SELECT sample_id, label, [l_quantity / 10, l_linenumber::DOUBLE, (l_partkey % 7)::DOUBLE] AS g FROM targets), e AS (SELECT sample_id, label, g, list_transform(g, lambda x: exp((x - list_max(g)) / 2)) AS e FROM l), pr AS (SELECT sample_id, label, g, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"


@query("fn_softmax_temperature", LOGIT_SQL + " SELECT sample_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2 FROM pr")
def fn_softmax_temperature(p: Panels):
    s = p.targets.select("sample_id", S.softmax(logits(), 2.0).alias("p"))
    return s.select("sample_id", *[R(F.col("p")[i]).alias(f"p{i}") for i in range(3)])


@query("fn_argmax", LOGIT_SQL + " SELECT sample_id, list_position(g, list_max(g)) - 1 AS best FROM pr")
def fn_argmax(p: Panels):
    return p.targets.select("sample_id", S.argmax(logits()).alias("best"))


@query("fn_deepgini", LOGIT_SQL + " SELECT sample_id, round(1 - list_sum(list_transform(p, lambda x: x * x)), 6) AS gini FROM pr")
def fn_deepgini(p: Panels):
    return p.targets.select("sample_id", R(S.deepgini(S.softmax(logits(), 2.0))).alias("gini"))


@query("fn_risk_map", "SELECT sample_id, CASE tax_band WHEN 'low' THEN 0.25 WHEN 'high' THEN 1.0 END AS points FROM targets")
def fn_risk_map(p: Panels):
    return p.targets.select("sample_id", S.mapped(F.col("tax_band"), {"low": 0.25, "high": 1.0}).alias("points"))


@query("fn_interval_components", risk.COMPONENT_SQL + " SELECT sample_id, round(lo, 6) AS lower, round(hi, 6) AS upper, round((lo + hi) / 2, 6) AS midpoint, round(kn, 6) AS known FROM comp")
def fn_interval_components(p: Panels):
    s = p.targets.select("sample_id", risk.components().alias("s"))
    return s.select("sample_id", *[R(F.col("s")[c]).alias(c) for c in ("lower", "upper", "midpoint", "known")])


@query("fn_region_score", "SELECT sample_id, round(list_avg(list_filter([CASE linestatus WHEN 'F' THEN 1.0 ELSE 0.5 END, CASE scale WHEN 'tiny' THEN 0.0 WHEN 'small' THEN 0.5 ELSE 1.0 END, CASE WHEN tax_band = 'unknown' THEN NULL ELSE 1.0 END], lambda x: x IS NOT NULL)), 6) AS visible FROM targets")
def fn_region_score(p: Panels):
    parts = F.array_compact(F.array(S.mapped(F.col("linestatus"), {"F": 1, "O": 0.5}), S.mapped(F.col("scale"), {"tiny": 0, "small": 0.5, "medium": 1, "large": 1}), F.when(F.col("tax_band") != "unknown", 1.0)))
    return p.targets.select("sample_id", R(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.size(parts))).alias("visible"))


@query("fn_risk_score_100", risk.SCORE_SQL + " SELECT sample_id, round(low, 6) AS low, round(high, 6) AS high, round(mid, 6) AS mid, round(known, 6) AS known FROM scores")
def fn_risk_score_100(p: Panels):
    return risk.scores(p.targets).select("sample_id", *[R(c).alias(c) for c in ("low", "high", "mid", "known")])


@query("fn_risk_score_13", "q AS (SELECT sample_id, CASE scale WHEN 'tiny' THEN 3 WHEN 'small' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE discount_band WHEN 'high' THEN 4 WHEN 'mid' THEN 2 ELSE 0 END + CASE linestatus WHEN 'F' THEN 2 ELSE 0 END AS k, CASE tax_band WHEN 'high' THEN 4 WHEN 'low' THEN 1 END AS t FROM targets) SELECT sample_id, k + coalesce(t, 0) AS low, k + coalesce(t, 4) AS high, (k + coalesce(t, 0) + k + coalesce(t, 4)) / 2 AS mid, (t IS NULL)::INT AS n_unknown FROM q")
def fn_risk_score_13(p: Panels):
    return risk.points_13(p.targets)


@query("fn_difficulty_points", "SELECT sample_id, round(least(3, greatest(0, log10(0.1 / area_ratio))) + CASE discount_band WHEN 'high' THEN 2 WHEN 'mid' THEN 1 ELSE 0 END + CASE tax_band WHEN 'high' THEN 1 ELSE 0 END, 6) AS difficulty FROM targets")
def fn_difficulty_points(p: Panels):
    return p.targets.select("sample_id", R(risk.difficulty()).alias("difficulty"))


@query("fn_rarity", "c AS (SELECT class_name, field, value, count(*) AS n FROM states GROUP BY ALL) SELECT class_name, field, value, n, round(1 - (n + 1) / (max(n) OVER (PARTITION BY class_name, field) + 1), 6) AS rarity FROM c")
def fn_rarity(p: Panels):
    return risk.rarity(states.support(p.states)).select("class_name", "field", "value", "n", R("rarity").alias("rarity"))


@query("fn_panel_score_a", "SELECT sample_id, CASE WHEN count(*) FILTER (WHERE NOT (model = 2 AND label = 0)) = 4 THEN round(avg(1 - correct), 6) END AS score FROM facts WHERE seed = 1 GROUP BY sample_id")
def fn_panel_score_a(p: Panels):
    f = p.facts.where("seed = 1").withColumn("valid", ~((F.col("model") == 2) & (F.col("label") == 0)))
    return risk.panel_share_wrong(f, 4).select("sample_id", R("score").alias("score"))


@query("fn_panel_score_b", LOGIT_SQL + ", m AS (SELECT sample_id, label, g, mo FROM pr CROSS JOIN range(1, 5) AS r(mo)), n AS (SELECT sample_id, list_transform(g, lambda x: exp((x - list_max(g)) / mo)) AS e, label FROM m) SELECT sample_id, round(1 - avg(e[label + 1] / list_sum(e)), 6) AS score FROM n GROUP BY sample_id")
def fn_panel_score_b(p: Panels):
    temperatures = p.spark.range(1, 5).select(F.col("id").alias("model"), F.col("id").cast("double").alias("temperature"))
    t = p.targets.select("sample_id", "label", logits().alias("logits")).withColumn("model", F.explode(F.sequence(F.lit(1), F.lit(4))))
    t = t.join(F.broadcast(temperatures), "model")  # one row for each model of the panel
    t = t.withColumn("p", S.softmax(F.col("logits"), F.col("temperature")))
    return t.groupBy("sample_id").agg(R(1 - F.avg(F.expr("p[label]"))).alias("score"))


@query("fn_wilson", "q AS (SELECT model, sum(1 - correct)::DOUBLE AS k, count(*)::DOUBLE AS n FROM facts GROUP BY model), z AS (SELECT *, 1.959963984540054 AS z FROM q) SELECT model, round(greatest(0, (k / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS low, round(least(1, (k / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 6) AS high FROM z")
def fn_wilson(p: Panels):
    n = p.facts.groupBy("model").agg(F.sum(1 - F.col("correct")).alias("k"), F.count("*").alias("n")).withColumn("w", S.wilson(F.col("k"), F.col("n")))
    return n.select("model", R("w.low").alias("low"), R("w.high").alias("high"))


@query("fn_fingerprint", "SELECT sample_id, sha256(concat_ws(chr(31), class_name, linestatus, scale)) AS fingerprint FROM targets")
def fn_fingerprint(p: Panels):
    return p.targets.select("sample_id", F.sha2(F.concat_ws("\x1f", "class_name", "linestatus", "scale"), 256).alias("fingerprint"))


@query("fn_expected_unique", "c AS (SELECT class_name, field, value, count(*) AS n FROM states GROUP BY ALL), t AS (SELECT class_name, field, sum(n) AS total, list(n) AS ns FROM c GROUP BY ALL) SELECT class_name, field, round(list_sum(list_transform(ns, lambda n: 1 - CASE WHEN total - n < 50 THEN 0 ELSE exp(lgamma(total - n + 1) - lgamma(total - n - 50 + 1) - lgamma(total + 1) + lgamma(total - 50 + 1)) END)), 4) AS expected FROM t WHERE total >= 50")
def fn_expected_unique(p: Panels):
    return risk.expected_unique(states.support(p.states), ["class_name", "field"], 50).select("class_name", "field", F.round("expected", 4).alias("expected"))


@query("udf_vector_dot", "SELECT a.vec_id, round(list_dot_product(a.v, b.v), 6) AS dot FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1000000")
def udf_vector_dot(p: Panels):
    a, b = p.vecs.alias("a"), p.vecs.alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1_000_000).select("a.vec_id", R(S.dot(F.col("a.v"), F.col("b.v"))).alias("dot"))
