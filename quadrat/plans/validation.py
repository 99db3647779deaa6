"""Joins, checks and sources over the panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.operators import metrics as M
from quadrat.operators import validation as V
from quadrat.plans.panels import MODELS, RUNS, Panels, query
from quadrat.plans.projections import LOGIT_SQL, R, logits
from quadrat.plans.windows import TIER_SQL, tiers
from quadrat.functions import scalar as S

# -- joins ------------------------------------------------------------------------------------


@query("jn_features_inner", "SELECT t.sample_id, t.scale, s.discount_band, round(b.confidence, 6) AS confidence FROM targets t JOIN second s USING (sample_id) JOIN boxes b USING (sample_id)")
def jn_features_inner(p: Panels):
    t = p.targets.select("sample_id", "scale").join(p.second.select("sample_id", "discount_band"), "sample_id")
    return t.join(p.boxes.select("sample_id", R("confidence").alias("confidence")), "sample_id")


@query("jn_predictions_fact", "SELECT sample_id, model, seed, predicted, correct FROM facts")
def jn_predictions_fact(p: Panels):
    return p.targets.select("sample_id", "label").join(p.preds.select("sample_id", "model", "seed", "predicted"), "sample_id").select("sample_id", "model", "seed", "predicted", (F.col("predicted") == F.col("label")).cast("int").alias("correct"))


@query("jn_review_overlay", "SELECT t.sample_id, coalesce(CASE WHEN t.l_partkey % 9 = 0 AND t.l_suppkey % 2 = 0 THEN s.discount_band END, t.discount_band) AS discount_band, CASE WHEN t.l_partkey % 9 = 0 AND t.l_suppkey % 2 <> 0 THEN 'hash_mismatch' END AS issue FROM targets t JOIN second s USING (sample_id)")
def jn_review_overlay(p: Panels):
    t = p.targets.withColumn("hash", F.sha2("sample_id", 256))
    ok = F.col("l_suppkey") % 2 == 0
    reviews = p.targets.where("l_partkey % 9 = 0").select("sample_id", F.when(ok, F.sha2("sample_id", 256)).otherwise("stale").alias("review_hash")).join(p.second.select("sample_id", F.col("discount_band").alias("review")), "sample_id")
    j = t.join(reviews, "sample_id", "left")
    same = F.col("hash") == F.col("review_hash")
    return j.select("sample_id", F.coalesce(F.when(same, F.col("review")), "discount_band").alias("discount_band"), F.when(F.col("review_hash").isNotNull() & ~same, "hash_mismatch").alias("issue"))


@query("jn_split_assign", "SELECT group_id, count(DISTINCT split) AS splits, count(DISTINCT class_name) AS classes FROM targets GROUP BY group_id HAVING count(DISTINCT class_name) > 1")
def jn_split_assign(p: Panels):
    return p.targets.groupBy("group_id").agg(F.count_distinct("split").alias("splits"), F.count_distinct("class_name").alias("classes")).where("splits > 1 or classes > 1")


@query("jn_anti_history", "SELECT sample_id FROM targets WHERE l_partkey NOT IN (SELECT l_partkey FROM targets WHERE split = 'D')")
def jn_anti_history(p: Panels):
    used = p.targets.where("split = 'D'").select("l_partkey").distinct()
    return p.targets.join(used, "l_partkey", "left_anti").select("sample_id")


@query("jn_split_overlap", "SELECT l_suppkey, count(DISTINCT split) AS splits FROM targets GROUP BY l_suppkey HAVING count(DISTINCT split) > 1")
def jn_split_overlap(p: Panels):
    return p.targets.groupBy("l_suppkey").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


@query("jn_same_cell_control", TIER_SQL + ", e AS (SELECT sample_id, avg(correct) AS y FROM facts GROUP BY sample_id), j AS (SELECT t.class_name, tier, y, discount_band = 'high' AS m FROM targets t JOIN tiers USING (sample_id) JOIN e USING (sample_id)), c AS (SELECT class_name, tier, avg(y) AS ctl FROM j WHERE NOT m GROUP BY ALL) SELECT class_name, round(avg(y - ctl), 6) AS difference, count(*) AS n FROM j JOIN c USING (class_name, tier) WHERE m GROUP BY class_name")
def jn_same_cell_control(p: Panels):
    e = p.facts.groupBy("sample_id").agg(F.avg("correct").alias("y"))
    j = tiers(p).select("sample_id", "class_name", "tier").join(p.targets.select("sample_id", (F.col("discount_band") == "high").alias("m")), "sample_id").join(e, "sample_id")
    control = j.where("not m").groupBy("class_name", "tier").agg(F.avg("y").alias("control"))
    return j.where("m").join(F.broadcast(control), ["class_name", "tier"]).groupBy("class_name").agg(R(F.avg(F.col("y") - F.col("control"))).alias("difference"), F.count("*").alias("n"))  # a row for each tier


@query("jn_score_previous", "a AS (SELECT model, seed, class_name, avg(correct) AS y FROM facts GROUP BY ALL), b AS (SELECT model, seed, class_name, y + CASE WHEN model = 2 THEN 0.001 ELSE 0 END AS y FROM a WHERE seed <> 3) SELECT model, seed, class_name, round(a.y, 6) AS \"new\", round(b.y, 6) AS \"old\" FROM a FULL JOIN b USING (model, seed, class_name) WHERE b.y IS NULL OR abs(a.y - b.y) > 1e-10")
def jn_score_previous(p: Panels):
    keys = ["model", "seed", "class_name"]
    a = p.facts.groupBy(*keys).agg(F.avg("correct").alias("y"))
    b = a.where("seed <> 3").withColumn("y", F.col("y") + F.when(F.col("model") == 2, 0.001).otherwise(0.0))
    return V.differences(a, b, keys, "y").select(*keys, R("new").alias("new"), R("old").alias("old"))


@query("jn_calibration_cohort", "SELECT sample_id FROM targets WHERE tax_band <> 'unknown'")
def jn_calibration_cohort(p: Panels):
    full = p.fields.groupBy("sample_id").agg(F.bool_and(F.col("value") != "unknown").alias("ok")).where("ok").select("sample_id")
    return p.targets.join(full, "sample_id", "left_semi").select("sample_id")


# -- checks -----------------------------------------------------------------------------------


@query("dq_schema_rules", "SELECT field, count(DISTINCT value) AS n_values, bool_or(value = 'unknown') AS has_unknown FROM fields GROUP BY field")
def dq_schema_rules(p: Panels):
    return p.fields.groupBy("field").agg(F.count_distinct("value").alias("n_values"), F.bool_or(F.col("value") == "unknown").alias("has_unknown"))


@query("dq_label_rules", "q AS (SELECT s.sample_id, list_filter([CASE WHEN s.linestatus = 'unknown' THEN 'linestatus_unknown' END, CASE WHEN s.discount_band = 'none' AND t.discount_band = 'high' THEN 'band_wrapped' END], lambda x: x IS NOT NULL) AS r FROM second s JOIN targets t USING (sample_id)) SELECT sample_id, unnest(r) AS code FROM q")
def dq_label_rules(p: Panels):
    j = p.second.join(p.targets.select("sample_id", F.col("discount_band").alias("first_band")), "sample_id")
    return V.issues(j, "sample_id", {"linestatus_unknown": F.col("linestatus") == "unknown", "band_wrapped": (F.col("discount_band") == "none") & (F.col("first_band") == "high")})


@query("dq_identity_binding", "SELECT sample_id, 'right' AS missing_in FROM targets WHERE split = 'D' AND l_partkey % 50 = 0")
def dq_identity_binding(p: Panels):
    d = p.targets.where("split = 'D'")
    return V.missing(d, d.where("l_partkey % 50 <> 0"), ["sample_id"])


@query("dq_exclusions", "u AS (SELECT sample_id, 'group' AS code FROM boxes WHERE is_group UNION ALL SELECT sample_id, 'depiction' FROM boxes WHERE is_depiction UNION ALL SELECT sample_id, 'unknown_tax' FROM targets WHERE tax_band = 'unknown') SELECT sample_id, string_agg(code, ',' ORDER BY code) AS reasons FROM u GROUP BY sample_id")
def dq_exclusions(p: Panels):
    a = V.issues(p.boxes, "sample_id", {"group": F.col("is_group"), "depiction": F.col("is_depiction")})
    return V.reasons([a, V.issues(p.targets, "sample_id", {"unknown_tax": F.col("tax_band") == "unknown"})], "sample_id")


@query("dq_stage_isolation", "SELECT sample_id, split, CASE WHEN split = 'B' THEN round(avg(1 - correct), 6) END AS score FROM facts JOIN targets USING (sample_id) GROUP BY sample_id, split")
def dq_stage_isolation(p: Panels):
    e = p.facts.groupBy("sample_id").agg(F.avg(1 - F.col("correct")).alias("e"))
    return p.targets.select("sample_id", "split").join(e, "sample_id").select("sample_id", "split", F.when(F.col("split") == "B", R("e")).alias("score"))


@query("dq_gates", "q AS (SELECT avg((tax_band <> 'unknown')::INT) AS known, count(*) - count(DISTINCT sample_id) AS rep, count(DISTINCT class_name) AS classes FROM targets) SELECT round(known, 6) AS known, rep AS repeats, classes, CASE WHEN rep > 0 THEN 'STOP' WHEN classes < 3 THEN 'REVISE' WHEN known < 0.95 THEN 'NEEDS_REVIEW' ELSE 'GO' END AS decision FROM q")
def dq_gates(p: Panels):
    q = p.targets.agg(F.avg((F.col("tax_band") != "unknown").cast("int")).alias("known"), (F.count("*") - F.count_distinct("sample_id")).alias("repeats"), F.count_distinct("class_name").alias("classes"))
    decision = F.when(F.col("repeats") > 0, "STOP").when(F.col("classes") < 3, "REVISE").when(F.col("known") < 0.95, "NEEDS_REVIEW").otherwise("GO")
    return q.select(R("known").alias("known"), "repeats", "classes", decision.alias("decision"))


@query("dq_balance", "SELECT class_name, split, count(*) AS n, (SELECT count(*) // 6 FROM targets) AS expected FROM targets GROUP BY ALL")
def dq_balance(p: Panels):
    n = p.targets.groupBy("class_name", "split").agg(F.count("*").alias("n"))
    return n.withColumn("expected", F.expr("sum(n) over () div 6"))  # six rows


@query("dq_harmonise", "SELECT class_name, sample_id, scale, NULL::VARCHAR AS discount_band FROM targets WHERE split = 'B' UNION ALL SELECT class_name, sample_id, NULL, discount_band FROM second")
def dq_harmonise(p: Panels):
    a = p.targets.where("split = 'B'").select("class_name", "sample_id", "scale")
    return a.unionByName(p.second.select("class_name", "sample_id", "discount_band"), allowMissingColumns=True)


@query("dq_freeze_compare", "SELECT 'reordered' AS now, count(*) AS rows_then, count(*) AS rows, true AS same FROM targets UNION ALL SELECT 'one_changed', count(*), count(*), false FROM targets UNION ALL SELECT 'one_less', count(*), count(*) - 1, false FROM targets")
def dq_freeze_compare(p: Panels):
    """The targets against themselves in another order, with one label changed, and with one row less."""
    t = p.targets.select("sample_id", "label")
    first = t.join(F.broadcast(t.agg(F.min("sample_id").alias("first"))), how="cross").withColumn("at", F.col("sample_id") == F.col("first"))  # one row
    cases = {"reordered": t.repartition("label"), "one_changed": first.select("sample_id", (F.col("label") + F.col("at").cast("int")).alias("label")), "one_less": first.where("not at").select("sample_id", "label")}
    out = None
    for name, now in cases.items():
        one = V.freeze_compare(t, now).select(F.lit(name).alias("now"), "rows_then", "rows", "same")
        out = one if out is None else out.unionByName(one)
    return out


def folder_files(p: Panels) -> DataFrame:
    """(name, length, rows, hash_sum) of each file of the folder's tables: lengths from the listing, contents as count and order-free sum of row hashes."""
    name = lambda c: F.regexp_extract(c, "/([^/]+[.]parquet(?:/[^/]+)?)$", 1).alias("name")
    files = p.spark.read.format("binaryFile").load(f"{p.sf_dir}/*.parquet").select(name("path"), "length")
    found = None
    for t in sorted(r.t for r in files.select(F.regexp_extract("name", "^(.+?)[.]parquet", 1).alias("t")).distinct().collect()):  # the tables
        rows = p.table(t)
        rows = rows.select(name("_metadata.file_path"), F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)").alias("h"))
        found = rows if found is None else found.unionByName(rows)
    prints = found.groupBy("name").agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("hash_sum"))
    return files.join(prints, "name", "left").select("name", "length", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("hash_sum", F.lit("0")).alias("hash_sum"))  # a file may be empty


@query("dq_manifest_diff", None)
def dq_manifest_diff(p: Panels):
    """All files of the data folder against a manifest in which one file is absent from the folder, one size and one content are wrong."""
    now = folder_files(p)
    known = now.select("name", F.when(F.col("name").startswith("region.parquet"), F.col("length") + 1).otherwise(F.col("length")).alias("length"), "rows", F.when(F.col("name").startswith("nation.parquet"), F.concat(F.lit("0"), "hash_sum")).otherwise(F.col("hash_sum")).alias("hash_sum"))
    gone = known.where("name like 'region.parquet%'").withColumn("name", F.lit("absent.parquet"))
    return V.manifest_diff(known.unionByName(gone), now)


PLANTED_SQL = "ch AS (SELECT sample_id, class_name, row_number() OVER (PARTITION BY class_name ORDER BY sha256(sample_id)) AS r FROM targets QUALIFY r <= 43), v AS (SELECT class_name, sample_id, r FROM ch WHERE r <= CASE class_name WHEN 'N' THEN 43 ELSE 40 END UNION ALL SELECT class_name, sample_id, r FROM ch WHERE class_name = 'R' AND r <= 2) SELECT class_name, 'over_budget' AS code, count(*) AS n FROM v GROUP BY class_name HAVING count(*) > 40 UNION ALL SELECT class_name, 'repeated', sum(c - 1)::BIGINT FROM (SELECT class_name, sample_id, count(*) AS c FROM v GROUP BY ALL HAVING count(*) > 1) GROUP BY class_name"


@query("sel_validate", PLANTED_SQL)
@query("sel_validate_planted", PLANTED_SQL)
def sel_validate_planted(p: Panels):
    """A selection with three rows too many of one class and two rows of another taken twice."""
    from quadrat.plans.aggregates import chosen

    more = chosen(p, 43).where("class_name = 'N'")
    twice = chosen(p, 2).where("class_name = 'R'")
    return V.selection_issues(chosen(p).where("class_name <> 'N'").unionByName(more).unionByName(twice), 40)


@query("snk_refuse_overwrite", "SELECT class_name, count(*) AS n, true AS refused FROM targets GROUP BY class_name")
def snk_refuse_overwrite(p: Panels):
    """What a place holds after a second write to it, and three into or above it while it was protected, were refused."""
    from pyspark.errors import AnalysisException

    from quadrat.sources import files

    # all places lie in the shared folder, so nothing else is at stake
    path, refused = saved(p), 0
    parent, _, name = path.rpartition("/")
    for place, error in ((path, AnalysisException), (f"{path}/inside", ValueError), (parent, ValueError), (f"{path}/../x/../{name}/inside", ValueError)):
        try:
            files.write_tables(p.targets.select("sample_id").limit(1), place, protected=[path] if error is ValueError else [p.sf_dir])
        except error:
            refused += 1
    kept = p.spark.read.parquet(f"{path}/parquet")
    return kept.groupBy("class_name").agg(F.count("*").alias("n"), F.lit(refused == 4).alias("refused"))


# -- sources ----------------------------------------------------------------------------------


def record_files(p: Panels, faulty: bool) -> str:
    """The first seed's predictions as gzip JSON lines, a folder ``{model}.jsonl.gz`` of parts for each model; with ``faulty``, some orders' records are wrong in one way each.  Even models name their numbers ``logits_10``."""
    from uuid import uuid4

    from quadrat.sources.shared import folder

    turn = F.element_at(F.split("sample_id", "-"), 1).cast("long") % 97 if faulty else F.lit(-1)
    told = F.array(*[F.struct(F.lit(m).alias("model"), F.col(of[0]).alias("predicted")) for m, of in RUNS.items()])
    d = p.runs.withColumn("turn", turn).where("turn <> 0").select("sample_id", "label", "turn", F.inline(told))
    d = d.withColumn("copy", F.explode(F.when(F.col("turn") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    name = lambda k: F.get(F.array(*map(F.lit, CLASS_IDS)), k)
    right = F.col("predicted") == F.col("label")
    row = F.struct(
        F.col("sample_id").alias("member"),
        (F.crc32("sample_id") + F.when(F.col("turn") == 4, 1).otherwise(0)).alias("index"),
        name((F.col("predicted") + F.when(F.col("turn") == 2, 1).otherwise(0)) % 3).alias("prediction"),
        F.when(F.col("turn") == 3, ~right).otherwise(right).alias("correct"),
        F.slice(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.when(k == F.col("predicted"), 5.5).otherwise(-1.25)), 1, F.when(F.col("turn") == 5, 2).otherwise(3)).alias("logits"),
        F.lit(None).cast("array<double>").alias("logits_10"),
        F.when(F.col("turn") == 6, "timeout").alias("error"),
    )
    ten = F.col("model") % 2 == 0
    numbers = row.getField("logits")
    row = row.withField("logits", F.when(~ten, numbers)).withField("logits_10", F.when(ten, numbers))  # a null isn't written
    line = F.when(F.col("turn") == 7, F.lit("{broken")).otherwise(F.to_json(row))
    path = f"{folder(p.spark)}/records-{uuid4().hex}"
    d.select(line.alias("value"), "model").write.partitionBy("model").option("compression", "gzip").text(path)
    hadoop = p.spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(p.spark._jsc.hadoopConfiguration())
    for m in range(1, MODELS + 1):
        fs.rename(hadoop(f"{path}/model={m}"), hadoop(f"{path}/{m}.jsonl.gz"))
    return path


CLASS_IDS = ("A", "N", "R")


@query("src_predictions_jsonl", "SELECT sample_id, model, seed, predicted BETWEEN 0 AND 2 AS valid FROM preds WHERE seed = 1")
def src_predictions_jsonl(p: Panels):
    """Records read from files, each valid if it has no issue."""
    from quadrat.sources import files

    p = p.spread  # records and manifest meet by member anyway
    manifest = p.targets.select(F.col("sample_id").alias("member"), F.crc32("sample_id").alias("index"), F.col("class_name").alias("class_id"))
    models = [str(m) for m in range(1, MODELS + 1)]
    rows = files.read_predictions(p.spark, record_files(p, False), models)
    g = files.prediction_groups(rows, manifest, CLASS_IDS).where("model is not null")
    bad = F.col("listed") & ((F.col("n") > 1) | (sum(F.col(c) for c in files.RECORD_CODES) > 0))
    j = g.select("member", "model", (~bad).alias("valid"), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("seed"))
    nobody = rows.where("member is null").select("member", "model", F.col("broken").isNull().alias("valid"), F.lit(1).alias("seed"))
    return j.unionByName(nobody).select(F.col("member").alias("sample_id"), F.col("model").cast("int").alias("model"), "seed", "valid")


@query("src_prediction_issues", "t AS (SELECT sample_id, model, split_part(sample_id, '-', 1)::BIGINT % 97 AS k FROM preds WHERE seed = 1), c(k, code) AS (VALUES (0, 'missing_prediction'), (1, 'duplicate_prediction'), (2, 'argmax_mismatch'), (3, 'historical_correctness_mismatch'), (4, 'manifest_index_mismatch'), (5, 'invalid_logits'), (6, 'inference_error'), (7, 'missing_prediction')) SELECT model, sample_id, code FROM t JOIN c USING (k) UNION ALL SELECT model, NULL, 'malformed_record' FROM t WHERE k = 7 UNION ALL SELECT 5, sample_id, 'missing_prediction_file' FROM targets")
def src_prediction_issues(p: Panels):
    """The issues of record files in which orders are planted with one fault each; the last model has no file."""
    from quadrat.sources import files

    p = p.spread  # records and manifest meet by member anyway
    manifest = p.targets.select(F.col("sample_id").alias("member"), F.crc32("sample_id").alias("index"), F.col("class_name").alias("class_id"))
    path, models = record_files(p, True), [str(m) for m in range(1, MODELS + 2)]
    absent = [m for m, file in files.prediction_files(p.spark, path, models).items() if file is None]
    found = files.prediction_issues(files.read_predictions(p.spark, path, models), manifest, CLASS_IDS, models, absent)
    return found.select(F.col("model").cast("int").alias("model"), F.col("member").alias("sample_id"), "code")


@query("src_logits_matrix", LOGIT_SQL + " SELECT sample_id, round(g[1], 6) AS g0, round(g[3], 6) AS g2 FROM l")
def src_logits_matrix(p: Panels):
    m = p.targets.select("sample_id", logits().alias("logits"))
    return m.join(p.targets.select("sample_id"), "sample_id", "left_semi").select("sample_id", R(F.col("logits")[0]).alias("g0"), R(F.col("logits")[2]).alias("g2"))


@query("src_schema_dictionary", "SELECT field, value, value = 'unknown' AS exclusive FROM (SELECT DISTINCT field, value FROM fields)")
def src_schema_dictionary(p: Panels):
    from quadrat.sources import files

    d = p.fields.groupBy("field").agg(F.to_json(F.array_sort(F.collect_set("value"))).alias("possible_values"))
    return files.dictionary(d, ("unknown",))


@query("src_filter_annotations", "SELECT class_name, count(*) AS n FROM targets WHERE class_name IN ('A', 'R') GROUP BY class_name")
def src_filter_annotations(p: Panels):
    return p.targets.select("class_name").where(F.col("class_name").isin("A", "R")).groupBy("class_name").agg(F.count("*").alias("n"))


#: What every 13th supplier's annotation file holds instead of an object with features, in turn.
SPOILT = ("{cut", '{"note":"x"}', "[1]")


def annotation_folder(p: Panels) -> str:
    """A file for each supplier (the target) with the states of its rows, as an annotator gives them; some files are spoilt."""
    from uuid import uuid4

    from quadrat.sources.shared import folder

    per = p.targets.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("scale")).alias("scales"), F.array_sort(F.collect_set("discount_band")).alias("bands"), F.max("ship_year").alias("last_year"))
    whole = F.to_json(F.struct(F.struct("scales", "bands", "last_year").alias("features")))
    spoilt = F.get(F.array(*map(F.lit, SPOILT)), (F.floor(F.col("l_suppkey") / 13) % 3).cast("int"))
    path = f"{folder(p.spark)}/annotations-{uuid4().hex}"
    rows = per.select(F.when(F.col("l_suppkey") % 13 == 0, spoilt).otherwise(whole).alias("value"), F.col("l_suppkey").alias("target"))
    rows.write.partitionBy("target").text(path)
    # Spark names a part file itself: it becomes {target}.json
    hadoop = p.spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(p.spark._jsc.hadoopConfiguration())
    for at in fs.listStatus(hadoop(path)):
        if at.isDirectory():
            for part in fs.listStatus(at.getPath()):
                fs.rename(part.getPath(), hadoop(at.getPath(), at.getPath().getName().partition("=")[2] + ".json"))
    return path


@query("src_annotation_json", "SELECT 'linestatus' AS field, linestatus AS value, count(*) AS n FROM targets GROUP BY ALL UNION ALL SELECT 'tags', v, count(*) FROM (SELECT scale AS v FROM targets UNION ALL SELECT discount_band FROM targets) WHERE v NOT IN ('unknown') GROUP BY ALL")
def src_annotation_json(p: Panels):
    from quadrat.sources import files

    raw = p.targets.select("sample_id", F.to_json(F.struct("linestatus", F.array("scale", "discount_band").alias("tags"))).alias("value"))
    return files.annotations(raw, "sample_id").groupBy("field", "value").agg(F.count("*").alias("n"))


@query("src_annotation_files", "f AS (SELECT l_suppkey, 'scales' AS field, scale AS value FROM targets UNION SELECT l_suppkey, 'bands', discount_band FROM targets UNION SELECT l_suppkey, 'last_year', max(ship_year) FROM targets GROUP BY l_suppkey), b AS (SELECT DISTINCT l_suppkey, CASE l_suppkey // 13 % 3 WHEN 1 THEN 'missing_features' ELSE 'malformed_annotation' END AS code FROM targets WHERE l_suppkey % 13 = 0) SELECT field, value, count(*) AS n FROM f WHERE l_suppkey % 13 <> 0 GROUP BY ALL UNION ALL SELECT 'issue', code, count(*) FROM b GROUP BY ALL")
def src_annotation_files(p: Panels):
    """Values and issues read from one JSON file for each supplier."""
    from quadrat.sources import files

    values, issues = files.annotation_files(p.spark, annotation_folder(p))
    return values.groupBy("field", "value").agg(F.count("*").alias("n")).unionByName(issues.groupBy(F.lit("issue").alias("field"), F.col("code").alias("value")).agg(F.count("*").alias("n")))


def controls(p: Panels):
    from quadrat.operators import matching

    t = p.targets
    return matching.nearest_controls(t.where("discount_band = 'high'"), t.where("discount_band = 'none'"), "sample_id", ["linestatus", "tax_band"], "area_ratio", "ship_year")


@query("jn_nearest_control", None)
def jn_nearest_control(p: Panels):
    """A control without discount for each target with a high one, alike in status and tax band, at the least total cost."""
    pairs, _ = controls(p)
    return pairs.withColumn("cost", F.round("cost", 6))


@query("jn_control_balance", "c AS (SELECT linestatus, tax_band, count(*) FILTER (WHERE discount_band = 'high') AS a, count(*) FILTER (WHERE discount_band = 'none') AS b FROM targets GROUP BY ALL) SELECT linestatus, tax_band, least(a, b) AS pairs, least(a, b) AS cases, least(a, b) AS controls, true AS near_best FROM c WHERE least(a, b) > 0")
def jn_control_balance(p: Panels):
    """Each block's pairs, how many different rows they use, and whether their cost is as near to the proven bound as stated."""
    from quadrat.operators import matching

    pairs, flows = controls(p)
    found = pairs.join(p.targets.select(F.col("sample_id").alias("case_id"), "linestatus", "tax_band"), "case_id")
    gap = flows.agg((F.sum(F.col("m") * F.col("cost")) - F.sum("bound")).alias("gap"), F.sum("m").alias("m"))  # one row
    near = F.col("gap") <= matching.EPSILON * F.col("m") + 1e-6
    return found.groupBy("linestatus", "tax_band").agg(F.count("*").alias("pairs"), F.count_distinct("case_id").alias("cases"), F.count_distinct("control_id").alias("controls")).crossJoin(F.broadcast(gap)).select("linestatus", "tax_band", "pairs", "cases", "controls", near.alias("near_best"))


def saved(p: Panels) -> str:
    """The targets as Parquet and CSV in a new folder of the shared one."""
    from uuid import uuid4

    from quadrat.sources.shared import folder
    from quadrat.sources import files

    path = f"{folder(p.spark)}/tables-{uuid4().hex}"
    files.write_tables(p.targets.select("sample_id", "class_name", "scale", F.array("linestatus", "discount_band").alias("bands")), path, protected=[p.sf_dir])
    return path


@query("src_manifest_csv", "SELECT sample_id, class_name, scale, '[\"' || linestatus || '\",\"' || discount_band || '\"]' AS bands FROM targets")
def src_manifest_csv(p: Panels):
    from quadrat.sources import files

    return files.manifest_csv(p.spark, f"{saved(p)}/csv", ["sample_id", "class_name", "scale", "bands"], "sample_id")


@query("snk_tables", "SELECT sample_id, class_name, scale, linestatus || '+' || discount_band AS bands FROM targets")
def snk_tables(p: Panels):
    return p.spark.read.parquet(f"{saved(p)}/parquet").withColumn("bands", F.array_join("bands", "+"))
