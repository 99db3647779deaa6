"""Near duplicates, leakage and neighbours over the embeddings panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.functions import scalar as S
from quadrat.operators import similar as Sim
from quadrat.plans.panels import Panels, query
from quadrat.plans.projections import R

# -- near duplicates: one rule, over all 64 signs ------------------------------------------------

#: Planted copies in turn: signs flipped (of the numbers nearest to zero), spread of the others' sizes; around both limits of the rule and of the radius.
CASES = ((0, 0.0), (4, 0.15), (4, 0.25), (5, 0.12), (7, 0.0), (8, 0.0), (8, 0.1), (9, 0.0))
RADIUS = 8

_CASE = lambda k: "CASE vec_id // 10 % 8 " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(CASES)) + " END"
NEAR_SQL = (
    f"nv0 AS (SELECT vec_id, embedding::DOUBLE[] AS v, {_CASE(0)} AS flips, ({_CASE(1)})::DOUBLE AS spread FROM embeddings WHERE vec_id % 10 = 0), "
    "nv1 AS (SELECT *, list_sort(list_transform(v, lambda x: abs(x)))[flips + 1] AS limit_ FROM nv0), "
    "near_vecs AS (SELECT vec_id, vec_id AS source, embedding::DOUBLE[] AS v, false AS planted FROM embeddings UNION ALL SELECT vec_id + 1000000, CASE WHEN vec_id // 80 % 2 = 0 THEN vec_id ELSE vec_id + 1000000 END, "
    "list_transform(v, lambda x, i: CASE WHEN abs(x) < limit_ THEN -x ELSE x END * (1 + CASE WHEN i % 2 = 1 THEN spread ELSE -spread END)), true FROM nv1), "
    "h64 AS (SELECT *, list_sum(list_transform(v, lambda x, i: CASE WHEN x > 0 AND i <= 32 THEN 1::BIGINT << least(i - 1, 31) ELSE 0 END))::BIGINT AS h0, list_sum(list_transform(v, lambda x, i: CASE WHEN x > 0 AND i > 32 AND i <= 64 THEN 1::BIGINT << least(greatest(i - 33, 0), 31) ELSE 0 END))::BIGINT AS h1 FROM near_vecs)"
)
PAIR64_SQL = NEAR_SQL + ", d64 AS (SELECT a.vec_id AS a, b.vec_id AS b, a.source = b.source AS same, a.v AS va, b.v AS vb, bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) AS distance FROM h64 a JOIN h64 b ON a.vec_id < b.vec_id), hp AS (SELECT * FROM d64 WHERE distance <= 8)"
CONFIRM64_SQL = PAIR64_SQL + ", cf AS (SELECT *, list_cosine_similarity(va, vb) AS cosine FROM hp), ok AS (SELECT * FROM cf WHERE (distance <= 4 AND cosine >= 0.98) OR (distance <= 8 AND cosine >= 0.995))"


def near_vecs(p: Panels):
    """The vectors and planted copies as in CASES, with all 64 signs as a hash; half of the copies keep their origin's source."""
    v, turn = F.col("v"), F.floor(F.col("vec_id") / 10) % len(CASES)
    case = lambda k: F.get(F.array(*[F.lit(c[k]) for c in CASES]), turn.cast("int"))
    real = p.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    least = F.get(F.array_sort(F.transform("v", F.abs)), case(0))
    copy = real.where("vec_id % 10 = 0").withColumn("least", least).withColumn("spread", case(1))
    changed = F.transform(v, lambda x, i: F.when(F.abs(x) < F.col("least"), -x).otherwise(x) * (1 + F.when(i % 2 == 0, F.col("spread")).otherwise(-F.col("spread"))))
    other = F.col("vec_id") + 1_000_000
    copy = copy.select(other.alias("vec_id"), F.when(F.floor(F.col("vec_id") / 80) % 2 == 0, F.col("vec_id")).otherwise(other).alias("source"), changed.alias("v"), F.lit(True).alias("planted"))
    return real.select("vec_id", F.col("vec_id").alias("source"), "v", F.lit(False).alias("planted")).unionByName(copy).withColumn("h", S.sign_bits(v))


def hashed(vecs: DataFrame) -> DataFrame:
    """vec_id, source, planted, h of ``near_vecs``, written once: 64 signs are a long expression to plan, and every step of a query asks for them."""
    from quadrat.sources.shared import ready

    return ready(vecs.select("vec_id", "source", "planted", "h"))


@query("sim_hamming_pairs_64", PAIR64_SQL + " SELECT a, b, distance FROM hp")
@query("sim_hamming_pairs", PAIR64_SQL + " SELECT a, b, distance FROM hp")
def sim_hamming_pairs_64(p: Panels):
    return Sim.hamming_pairs(hashed(near_vecs(p)), None, "vec_id", "h", RADIUS)


@query("sim_hamming_classes_64", NEAR_SQL + ", hc AS (SELECT h0, h1, min(vec_id) AS class FROM h64 GROUP BY ALL), lk AS (SELECT a.class, count(*) AS n FROM hc a JOIN hc b ON a.class <> b.class AND bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) <= 8 GROUP BY a.class) SELECT vec_id, class, coalesce(n, 0) AS n_links FROM h64 JOIN hc USING (h0, h1) LEFT JOIN lk USING (class)")
def sim_hamming_classes_64(p: Panels):
    """Each vector's class of equal hashes and the number of other classes near to it; no copies are paired."""
    members, links = Sim.hamming_classes(hashed(near_vecs(p)), "vec_id", "h", RADIUS)
    n = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))
    return members.join(n, "class", "left").select("vec_id", "class", F.coalesce("n", F.lit(0)).alias("n_links"))


@query("sim_cosine_confirm_64", CONFIRM64_SQL + " SELECT a, b, distance, round(cosine, 6) AS cosine FROM ok")
@query("sim_cosine_confirm", CONFIRM64_SQL + " SELECT a, b, distance, round(cosine, 6) AS cosine FROM ok")
def sim_cosine_confirm_64(p: Panels):
    n = near_vecs(p)
    return Sim.confirmed(Sim.hamming_pairs(hashed(n), None, "vec_id", "h", RADIUS), n, "vec_id", "v").withColumn("cosine", R("cosine"))


@query("sim_duplicate_status_64", CONFIRM64_SQL + ", al AS (SELECT a, b, 'corroborated' AS s, 2 AS o FROM ok UNION ALL SELECT a, b, 'same_source', 1 FROM hp WHERE same UNION ALL SELECT a, b, 'exact', 0 FROM hp WHERE distance = 0) SELECT a, b, arg_min(s, o) AS status FROM al GROUP BY a, b")
@query("sim_duplicate_status", CONFIRM64_SQL + ", al AS (SELECT a, b, 'corroborated' AS s, 2 AS o FROM ok UNION ALL SELECT a, b, 'same_source', 1 FROM hp WHERE same UNION ALL SELECT a, b, 'exact', 0 FROM hp WHERE distance = 0) SELECT a, b, arg_min(s, o) AS status FROM al GROUP BY a, b")
def sim_duplicate_status_64(p: Panels):
    from quadrat.sources.shared import ready

    n = near_vecs(p)
    h = hashed(n)
    pairs = ready(Sim.hamming_pairs(h, None, "vec_id", "h", RADIUS))  # asked for three times
    source = lambda k: h.select(F.col("vec_id").alias(k), F.col("source").alias(f"s{k}"))
    tagged = lambda df, s, o: df.select("a", "b", F.lit(s).alias("s"), F.lit(o).alias("o"))
    same = pairs.join(source("a"), "a").join(source("b"), "b").where("sa = sb")
    u = tagged(Sim.confirmed(pairs, n, "vec_id", "v"), "corroborated", 2).unionByName(tagged(same, "same_source", 1)).unionByName(tagged(pairs.where("distance = 0"), "exact", 0))
    return u.groupBy("a", "b").agg(F.min_by("s", "o").alias("status"))


@query("sim_cross_leakage_64", NEAR_SQL + ", x AS (SELECT a.vec_id AS a, bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) AS distance, list_cosine_similarity(a.v, b.v) AS cosine FROM h64 a JOIN h64 b ON a.planted AND NOT b.planted) SELECT a, min(distance) AS distance, bool_or((distance <= 4 AND cosine >= 0.98) OR cosine >= 0.995) AS leaks FROM x WHERE distance <= 8 GROUP BY a")
@query("sim_cross_leakage", NEAR_SQL + ", x AS (SELECT a.vec_id AS a, bit_count(xor(a.h0, b.h0)) + bit_count(xor(a.h1, b.h1)) AS distance, list_cosine_similarity(a.v, b.v) AS cosine FROM h64 a JOIN h64 b ON a.planted AND NOT b.planted) SELECT a, min(distance) AS distance, bool_or((distance <= 4 AND cosine >= 0.98) OR cosine >= 0.995) AS leaks FROM x WHERE distance <= 8 GROUP BY a")
def sim_cross_leakage_64(p: Panels):
    """Planted rows near to others: the least distance, and whether a pair meets the whole rule."""
    n = near_vecs(p)
    h = hashed(n)
    pairs = Sim.hamming_pairs(h.where("planted"), h.where("not planted"), "vec_id", "h", RADIUS)
    ok = Sim.confirmed(pairs, n, "vec_id", "v").select("a").distinct().withColumn("ok", F.lit(True))
    return pairs.groupBy("a").agg(F.min("distance").alias("distance")).join(ok, "a", "left").select("a", "distance", F.coalesce("ok", F.lit(False)).alias("leaks"))


@query("sim_cosine_topk", "q AS (SELECT * FROM vecs WHERE vec_id % 50 = 0), j AS (SELECT q.vec_id AS q, p.vec_id AS id, round(list_cosine_similarity(q.v, p.v), 9) AS cosine FROM q JOIN vecs p ON p.vec_id <> q.vec_id) SELECT q, id, round(cosine, 6) AS cosine FROM j QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) <= 5")
def sim_cosine_topk(p: Panels):
    q = p.vecs.where("vec_id % 50 = 0")  # the query set; the pool is all rows
    return Sim.nearest(q, p.vecs, "vec_id", "v", 5).select("q", "id", R("cosine").alias("cosine"))


DSA_SQL = (
    "tr AS (SELECT vec_id AS id, label, v FROM vecs WHERE NOT planted), q AS (SELECT vec_id AS q, predicted AS want, v FROM vecs WHERE NOT planted AND vec_id % 50 = 0), "
    "o AS (SELECT q, id, round(list_cosine_similarity(q.v, tr.v), 9) AS c FROM q JOIN tr ON label = want AND id <> q QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, id) = 1), "
    "e AS (SELECT a.id, max(round(list_cosine_similarity(a.v, b.v), 9)) AS c FROM tr a JOIN tr b ON a.label <> b.label WHERE a.id IN (SELECT id FROM o) GROUP BY a.id) "
    "SELECT q, round(sqrt(greatest(0, 2 - 2 * o.c)) / greatest(sqrt(greatest(0, 2 - 2 * e.c)), 1e-12), 6) AS dsa FROM o JOIN e USING (id)"
)


@query("sim_dsa", DSA_SQL)
def sim_dsa(p: Panels):
    """Distance to the nearest of the predicted class over that one's distance to the nearest of another class."""
    train = p.vecs.where("not planted")
    distance = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("cosine")))
    own = Sim.nearest(train.where("vec_id % 50 = 0"), train, "vec_id", "v", 1, groups=("predicted", "label", True)).select("q", "id", distance.alias("d"))  # the query set
    met = train.join(own.select(F.col("id").alias("vec_id")).distinct(), "vec_id", "left_semi")
    other = Sim.nearest(met, train, "vec_id", "v", 1, groups=("label", "label", False)).select(F.col("q").alias("id"), distance.alias("e"))
    return own.join(other, "id").select("q", R(F.col("d") / F.greatest(F.col("e"), F.lit(1e-12))).alias("dsa"))


def text_groups(p: Panels):
    """Documents of equal text, each linked to the smallest."""
    d = p.table("documents").select("doc_id", F.sha2("text", 256).alias("h"))
    least = d.groupBy("h").agg(F.min("doc_id").alias("b"))
    return d.join(least, "h").select(F.col("doc_id").alias("a"), "b")


@query("sim_groups", "SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS root FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def sim_groups(p: Panels):
    from quadrat.sources.shared import ready

    return Sim.components(ready(text_groups(p)))


@query("sim_conflicts_in_group", "SELECT min(doc_id) AS root, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def sim_conflicts_in_group(p: Panels):
    d = p.table("documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return d.groupBy("h").agg(F.min("doc_id").alias("root"), F.count("*").alias("n"), F.count_distinct("source").alias("sources")).where("sources > 1").select("root", "n", "sources")


def error_clusters(wrong: DataFrame) -> DataFrame:
    """(class_name, vec_id, cluster) of wrong samples (class_name, vec_id, v): k-means on the normalised vectors of each class, the best of 20 starts."""
    from quadrat.operators.clusters import clusters

    found = clusters(wrong.select(F.col("class_name").alias("group"), F.col("vec_id").alias("id"), "v"))
    return found.select(F.col("group").alias("class_name"), F.col("id").alias("vec_id"), "cluster")


def wrong_vecs(p: Panels) -> DataFrame:
    return p.vecs.where("predicted <> label").select(F.col("label").alias("class_name"), "vec_id", "v")


@query("sim_error_clusters", None)
def sim_error_clusters(p: Panels):
    """The cluster of each wrong sample inside its class; the panel holds one run."""
    return error_clusters(wrong_vecs(p))


QUALIFY_SQL = (
    PAIR64_SQL + ", o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n, coalesce(before, []) AS before FROM near_vecs LEFT JOIN (SELECT b, list(a) AS before FROM hp GROUP BY b) ON b = vec_id), "
    "acc(n, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.n, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, vec_id) END FROM acc JOIN o ON o.n = acc.n + 1) "
    "SELECT unnest(kept) AS vec_id FROM acc WHERE n = (SELECT count(*) FROM o)"
)


@query("sim_qualify_priority", QUALIFY_SQL)
def sim_qualify_priority(p: Panels):
    """In the order of ids, a row that duplicates an accepted one is skipped; rounds on the duplicate graph."""
    from quadrat.sources.shared import ready

    vecs = hashed(near_vecs(p))
    e = Sim.hamming_pairs(vecs, None, "vec_id", "h", RADIUS).select("a", "b")
    accepted = rejected = None
    left = ready(e)
    while not left.isEmpty():
        # accepted: nodes whose undecided neighbours all come later; rejected: their neighbours
        now = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        out = left.join(now, "a", "left_semi").select(F.col("b").alias("a")).distinct()
        accepted = now if accepted is None else accepted.unionByName(now)
        rejected = out if rejected is None else rejected.unionByName(out)
        left = ready(left.join(now, "a", "left_anti").join(out, "a", "left_anti").join(out.select(F.col("a").alias("b")), "b", "left_anti"))
    none = vecs.select(F.col("vec_id").alias("a")).limit(0)
    rejected = none if rejected is None else rejected
    return vecs.select("vec_id").join(rejected.select(F.col("a").alias("vec_id")), "vec_id", "left_anti")
