"""Selection over the panels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.functions import scalar as S
from quadrat.operators import sampling as Sm
from quadrat.operators import selection as Sel
from quadrat.plans.panels import FIELDS, Panels, query
from quadrat.plans.projections import LOGIT_SQL, R, logits
from quadrat.plans.sampling import CELL_SQL, QUOTA_SQL, cell_quotas, celled, scale_quotas
from quadrat.plans.windows import tiers
from quadrat.sources.shared import ready

RARE_SQL = "n AS (SELECT class_name, field, value, count(*) AS n FROM states GROUP BY ALL), rs AS (SELECT s.class_name, s.sample_id, round(sum(1 / n), 9) AS score FROM states s JOIN n USING (class_name, field, value) GROUP BY ALL)"


@query("sel_static_rarity", QUOTA_SQL + ", " + RARE_SQL + " SELECT class_name, sample_id FROM (SELECT t.class_name, scale, t.sample_id, row_number() OVER (PARTITION BY t.class_name, scale ORDER BY score DESC, t.sample_id) AS r FROM targets t JOIN rs USING (sample_id)) JOIN quotas USING (class_name, scale) WHERE r <= quota")
def sel_static_rarity(p: Panels):
    s = Sel.static_rarity(p.states, ["class_name"]).withColumn("score", F.round("score", 9)).join(p.targets.select("sample_id", "scale"), "sample_id")
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("class_name", "scale").orderBy(F.desc("score"), "sample_id"))).where("r <= 200")  # no quota is more
    return r.join(F.broadcast(scale_quotas(p).select("class_name", "scale", "quota")), ["class_name", "scale"]).where("r <= quota").select("class_name", "sample_id")  # cells are few


@query("sel_score_quota", CELL_SQL + ", " + LOGIT_SQL + ", gi AS (SELECT sample_id, round(1 - list_sum(list_transform(p, lambda x: x * x)), 9) AS g FROM pr) SELECT class_name, sample_id FROM (SELECT t.class_name, tier, t.scale, sample_id, row_number() OVER (PARTITION BY t.class_name, tier, t.scale ORDER BY g DESC, sample_id) AS r FROM tiers JOIN targets t USING (sample_id) JOIN gi USING (sample_id)) JOIN cellq USING (class_name, tier, scale) WHERE r <= quota")
def sel_score_quota(p: Panels):
    g = p.targets.select("sample_id", F.round(S.deepgini(S.softmax(logits(), 2.0)), 9).alias("g"))
    r = celled(p).join(g, "sample_id").withColumn("r", F.row_number().over(Window.partitionBy("class_name", "tier", "scale").orderBy(F.desc("g"), "sample_id"))).where("r <= 40")  # no quota is more
    return r.join(F.broadcast(cell_quotas(p)), ["class_name", "tier", "scale"]).where("r <= quota").select("class_name", "sample_id")  # cells are few


def signed(p: Panels, budget: int, tie: str = "min", cell: bool = False):
    rows = p.sets.join(tiers(p).select("sample_id", F.col("tier").cast("string").alias("cell")), "sample_id") if cell else p.sets.withColumn("cell", F.lit("all"))
    return Sel.folded(rows, budget, tie)


def tier_quotas(p: Panels, budget: int):
    c = tiers(p).groupBy("class_name", "tier").agg(F.count("*").alias("n"))
    return Sm.largest_remainder(c, ["class_name"], "n", F.lit(budget), ["tier"]).select("class_name", F.col("tier").cast("string").alias("cell"), "quota")


def rounded(df):
    return df.withColumn("gain", R("gain"))


@query("sel_greedy_linear", None)
def sel_greedy_linear(p: Panels):
    return rounded(Sel.greedy(signed(p, 20, "max"), 20, "linear", 10, tie="max"))


@query("sel_greedy_concave", None)
def sel_greedy_concave(p: Panels):
    return rounded(Sel.greedy(signed(p, 20), 20, "concave", 20))


@query("sel_greedy_quota", None)
def sel_greedy_quota(p: Panels):
    return rounded(Sel.greedy(signed(p, 20, cell=True), 20, "concave", 20, quotas=tier_quotas(p, 20)))


@query("sel_set_cover", None)
def sel_set_cover(p: Panels):
    return rounded(Sel.greedy(signed(p, 60), 60, "linear", 1, until_covered=True))


@query("sel_deficit_supplement", None)
def sel_deficit_supplement(p: Panels):
    from quadrat.plans.aggregates import chosen_counts

    start = chosen_counts(p).select("class_name", F.concat_ws("=", "field", "value").alias("state"), "n")
    return rounded(Sel.greedy(signed(p, 20), 20, "deficit", 30, start=start))


@query("sel_two_stage", None)
def sel_two_stage(p: Panels):
    """A gap stage, then a novelty stage that starts from its counts."""
    s = signed(p, 20)
    gap = Sel.greedy(s, 10, "linear", 3).select("class_name", "sample_id", "rank", "gain", F.lit("gap").alias("stage"))
    start = p.states.join(F.broadcast(gap.select("sample_id")), "sample_id", "left_semi").groupBy("class_name", F.concat_ws("=", "field", "value").alias("state")).agg(F.count("*").alias("n"))  # ten a class
    rest = p.sets.join(F.broadcast(gap.select("sample_id")), "sample_id", "left_anti").withColumn("cell", F.lit("all"))
    new = Sel.greedy(Sel.folded(rest, 10), 10, "novelty", 1_000_000, start=start)
    return rounded(gap.unionByName(new.select("class_name", "sample_id", (F.col("rank") + 10).alias("rank"), "gain", F.lit("novelty").alias("stage"))))


@query("sel_heldout_groups", None)
def sel_heldout_groups(p: Panels):
    """Each field is left out of the selection once and then its states are counted in it."""
    out = None
    whole = ready(signed(p, 20))  # first ids of each signature; the table is read once
    of = whole.select("class_name", F.explode("ids").alias("sample_id"), "states")
    for field in FIELDS:  # of the dictionary
        picks = Sel.greedy(Sel.without(whole, field, 20), 20, "concave", 20)
        got = of.join(F.broadcast(picks), ["class_name", "sample_id"]).select("class_name", F.explode("states").alias("state")).where(F.startswith("state", F.lit(f"{field}=")))  # 20 a class
        g = got.groupBy("class_name").agg(F.count_distinct("state").alias("met")).withColumn("held_out", F.lit(field))
        out = g if out is None else out.unionByName(g)
    return out


@query("sel_trace", None)
def sel_trace(p: Panels):
    """Each step with its gain and the states met before and after it."""
    g = Sel.greedy(signed(p, 20), 20, "concave", 20)
    first = g.join(p.states, ["class_name", "sample_id"]).groupBy("class_name", "field", "value").agg(F.min("rank").alias("rank")).groupBy("class_name", "rank").agg(F.count("*").alias("new"))
    j = g.join(first, ["class_name", "rank"], "left").na.fill(0, ["new"])
    after = F.sum("new").over(Window.partitionBy("class_name").orderBy("rank"))
    return rounded(j.select("class_name", "rank", "sample_id", "gain", (after - F.col("new")).alias("before"), after.alias("after")))


@query("sel_kcenter", None)
def sel_kcenter(p: Panels):
    return Sel.k_center(p.vecs.where("not planted"), "vec_id", "v", 6)[0]


@query("sel_swap_repair", None)
def sel_swap_repair(p: Panels):
    """Hash draws of 40 a class, repaired inside the scale cells."""
    from quadrat.plans.aggregates import chosen

    s = Sel.repair_rows(p.sets_with(F.col("scale").alias("cell")), chosen(p).select("sample_id"), 40, 1.0, 0.9, 10)
    return s.select(*[R(c).alias(c) if kind == "double" else F.col(c) for c, kind in s.dtypes])
