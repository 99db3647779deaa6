"""Operators on small tables with results worked out by hand, and invariants."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from quadrat.functions import scalar as S
from quadrat.operators import diagnosis, matching, ranking, sampling, selection, similar, stats, validation
from quadrat.sources import files
from quadrat.streaming import attempts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_interval_spans_the_unknown(spark):
    got = one(spark, S.interval([(F.lit(1.0), 0.5), (F.lit(None).cast("double"), 0.5)]))
    assert (got.lower, got.upper, got.midpoint) == (0.5, 1.0, 0.75)


def test_unmapped_value_is_an_error(spark):
    with pytest.raises(Exception, match="without points"):
        one(spark, S.mapped(F.lit("odd"), {"low": 1.0}))


def test_iou_of_empty_boxes_is_nothing(spark):
    z = [F.lit(0.0)] * 4
    assert one(spark, S.box_iou(z, z)) == 0


def test_average_rank_on_ties(spark):
    d = spark.createDataFrame([(1, 5), (1, 5), (1, 9)], "g int, v int")
    assert sorted(r["rank"] for r in ranking.average_rank(d, "v", ["g"]).collect()) == [1.5, 1.5, 3.0]


def test_auc_of_ties(spark):
    d = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)], "g int, s int, e int")
    assert stats.error_auc(d, "s", "e", ["g"]).first().auc == 0.5


def test_constant_ranks_give_null(spark):
    d = spark.createDataFrame([(1, 1, 1), (1, 1, 2)], "g int, x int, y int")
    assert stats.spearman(d, "x", "y", ["g"]).first().rho is None


def test_a_mixture_can_fake_a_gap(spark):
    # tiers 1 and 2 of 40; the state is on 5 and 35; correct only in tier 1
    cells = spark.createDataFrame([("s", 1, 5, 5, 35, 35), ("s", 2, 35, 0, 5, 0)], "k string, tier int, n1 int, k1 int, n0 int, k0 int")
    got = diagnosis.standardised_gaps(cells, ["k"]).first()
    assert (round(got.pooled, 9), got.standardised) == (-0.75, 0.0)


def test_quota_sums_to_the_budget(spark):
    d = spark.createDataFrame([("a", c, n) for c, n in zip("xyz", (1, 1, 1), strict=True)], "g string, c string, n int")
    q = {r.c: r.quota for r in sampling.largest_remainder(d, ["g"], "n", F.lit(10), ["c"]).collect()}
    assert q == {"x": 4, "y": 3, "z": 3}


def test_risk_weighted_allocation(spark):
    d = spark.createDataFrame([("a", t) for t in range(1, 6)], "g string, tier int")
    q = sorted((r.tier, r.quota) for r in sampling.largest_remainder(d, ["g"], "tier", F.lit(200), ["tier"]).collect())
    assert [n for _, n in q] == [13, 27, 40, 53, 67]


def plain_greedy(rows, budget, kind, cap, tie):
    left, counts, out = dict(rows), {}, []
    for _ in range(min(budget, len(left))):
        gains = {i: sum(selection.weight(kind, counts.get(s, 0), cap) for s in st) for i, st in left.items()}
        top = max(gains.values())
        best = (min if tie == "min" else max)(i for i, g in gains.items() if abs(g - top) <= 1e-12)
        for s in left.pop(best):
            counts[s] = counts.get(s, 0) + 1
        out.append(best)
    return out


@pytest.mark.parametrize("pool", [1000, 2])
@pytest.mark.parametrize("kind,tie", [("linear", "max"), ("concave", "min"), ("novelty", "min"), ("deficit", "max")])
def test_greedy_equals_the_plain_rule(spark, monkeypatch, kind, tie, pool):
    monkeypatch.setattr(selection, "POOL", pool)  # one round, and several
    rng = random.Random(kind)
    rows = {f"s{i:02}": sorted({f"f{k}={rng.choice('ab')}" for k in range(3)}) for i in range(30)}
    states = spark.createDataFrame([("c", i, *s.split("=")) for i, st in rows.items() for s in st], "class_name string, sample_id string, field string, value string")
    cells = spark.createDataFrame([("c", i, "all") for i in rows], "class_name string, sample_id string, cell string")
    got = selection.greedy(selection.signatures(states, cells, 12, tie), 12, kind, 4, tie=tie).orderBy("rank").collect()
    assert [r.sample_id for r in got] == plain_greedy(rows, 12, kind, 4, tie)


@pytest.mark.parametrize("pool", [1, 4, 1000])
def test_farthest_first_in_few_passes(spark, pool):
    rng = random.Random(8)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(3)]) for i in range(90)] + [(200 + i, [1.0, 0.0, 0.0]) for i in range(4)] + [(300, None)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    u = {i: unit(v) for i, v in rows if v}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    centre = [sum(x[j] for x in u.values()) / len(u) for j in range(3)]
    picks = [min(u, key=lambda i: (-round(dot(u[i], centre), 9), i))]
    while len(picks) < 12:
        d = {i: min(max(0.0, round(1 - dot(u[i], u[j]), 9)) for j in picks) for i in u if i not in picks}
        picks.append(min(d, key=lambda i: (-d[i], i)))
    got, passes = selection.k_center(spark.createDataFrame(rows, "id long, v array<double>").repartition(3), "id", "v", 12, pool)
    assert [r.id for r in got.orderBy("rank").collect()] == picks
    assert passes == 2 if pool == 1000 else passes <= 12
    few = spark.createDataFrame(rows[:3], "id long, v array<double>")
    assert sorted(r.id for r in selection.k_center(few, "id", "v", 9, pool)[0].collect()) == [0, 1, 2]
    assert selection.k_center(few.limit(0), "id", "v", 9, pool)[0].collect() == []


def test_hamming_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, rng.getrandbits(63) if i % 3 else 7 ^ (1 << (i % 60))) for i in range(60)] + [(100, 7), (101, 7)]
    d = spark.createDataFrame(rows, "id long, h long")
    got = {(r.a, r.b) for r in similar.hamming_pairs(d, None, "id", "h", 4).collect()}
    assert got == {(a, b) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 4}


def test_band_rows_are_never_broadcast(spark, capsys):
    """66 rows a hash meet by a shuffle, however small the optimizer takes them for."""
    d = spark.range(40).select("id", F.xxhash64("id").alias("h"))
    similar.hamming_pairs(d, None, "id", "h", 8).explain()
    plan = [x for x in capsys.readouterr().out.splitlines() if "Join" in x and "part#" in x]
    assert plan and all("SortMergeJoin" in x for x in plan)


def test_components_of_a_chain(spark):
    spark.sparkContext.setCheckpointDir("/tmp/quadrat-test")
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 91), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in similar.components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 91: 90}


def test_softmax_sums_to_one(spark):
    p = one(spark, S.softmax(F.array(F.lit(1000.0), F.lit(999.0))))
    assert math.isclose(sum(p), 1) and math.isclose(p[0], 1 / (1 + math.exp(-1)))


def test_differences_see_a_missing_row(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12)], "k int, v double")
    assert [r.k for r in validation.differences(a, b, ["k"], "v").collect()] == [2]


def test_manifest_with_byte_order_mark_and_repeat(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id,name\n1,a\n2,b\n", encoding="utf-8")
    assert files.manifest_csv(spark, str(tmp_path / "m.csv"), ["id", "name"], "id").count() == 2
    (tmp_path / "r.csv").write_text("id,name\n1,a\n1,b\n", encoding="utf-8")
    with pytest.raises(ValueError, match="repeated"):
        files.manifest_csv(spark, str(tmp_path / "r.csv"), ["id", "name"], "id")


def test_existing_output_is_refused(spark, tmp_path):
    d = spark.range(3).withColumn("l", F.array(F.lit(1)))
    files.write_tables(d, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_tables(d, str(tmp_path / "o"))
    (tmp_path / "link").symlink_to(tmp_path / "o")
    inner = tmp_path / "o" / "parquet"
    for place, kept in [("o/x", "o"), ("o", "o"), ("o", "o/parquet"), ("", "o"), ("o/../q/../o/x/y", "o"), ("new/../o/z", "o"), ("o/new/deep", "o/")]:
        for scheme in ("", "file:", "file://"):
            with pytest.raises(ValueError, match="protected"):
                files.write_tables(d, f"{scheme}{tmp_path}/{place}", [f"{tmp_path}/{kept}"])
    assert sorted(x.name for x in (tmp_path / "o").iterdir()) == ["csv", "parquet"] and inner.is_dir()
    files.write_tables(d, str(tmp_path / "other"), [str(tmp_path / "o")])
    files.write_tables(d, str(tmp_path / "o2"), [str(tmp_path / "o")])  # a name that only begins alike is apart


def reference_files(folder):
    """Prediction files as the reference's own fixture has them: two classes, 40 members, three models; then faults."""
    import gzip
    import json

    manifest = []
    for i in range(20):
        c = "ab"[i % 2]
        manifest += [(f"train/{c}/{c}_{i}.png", 2 * i, c), (f"base/{c}_{i}.png", 2 * i + 1, c)]
    for model in ("m1", "m2", "v"):
        with gzip.open(folder / f"{model}.jsonl.gz", "wt") as out:
            for member, index, c in manifest:
                i = index // 2
                predicted = {"a": "b", "b": "a"}[c] if i % 4 == 0 else c
                out.write(json.dumps({"index": index, "member": member, "prediction": predicted, "correct": predicted == c, "logits_10": [6.0, 0.0] if predicted == "a" else [0.0, 6.0]}) + "\n")
    return [r for r in manifest if r[0].startswith("base/")]


def test_the_references_prediction_files_have_no_issue(spark, tmp_path):
    import json

    members = spark.createDataFrame(reference_files(tmp_path), "member string, index long, class_id string")
    models = ["m1", "m2", "v"]
    assert files.prediction_files(spark, str(tmp_path), [*models, "gone"])["gone"] is None
    records = files.read_predictions(spark, str(tmp_path), models)
    assert records.count() == 120 and {r.model for r in records.select("model").distinct().collect()} == set(models)
    assert files.prediction_issues(records, members, ["a", "b"], models).collect() == []

    row = lambda **x: json.dumps({"index": 1, "member": "base/a_0.png", "prediction": "b", "correct": False, "logits_10": [0.0, 6.0]} | x)
    faults = {
        row(): None,
        row(logits_10=[True, 1.0]): "invalid_logits",
        row(logits_10=None, logits=[0.0, 6.0]): "invalid_logits",
        row(logits_10=[0.0, float("nan")]): "invalid_logits",
        row(logits_10="[0.0, 6.0"): "invalid_logits",
        row(prediction="a"): "argmax_mismatch",
        row(correct=None): "historical_correctness_mismatch",
        row(correct=0): "historical_correctness_mismatch",
        row(index=None): "manifest_index_mismatch",
        row(index={"a": 1}): "manifest_index_mismatch",
        row(error="timeout"): "inference_error",
        "{cut": "malformed_record",
        "[1, 2]": "malformed_record",
    }
    one = members.where("member = 'base/a_0.png'")
    for k, (line, code) in enumerate(faults.items()):
        (tmp_path / f"f{k}.jsonl").write_text(line + "\n")
        found = files.prediction_issues(files.read_predictions(spark, str(tmp_path), [f"f{k}"]), one, ["a", "b"], [f"f{k}"]).collect()
        assert {r.code for r in found} - {"missing_prediction"} == ({code} if code else set()), line
    gone = files.prediction_issues(files.read_predictions(spark, str(tmp_path), ["gone"]), one, ["a", "b"], ["gone"], ["gone"]).collect()
    assert [(r.model, r.member, r.code) for r in gone] == [("gone", "base/a_0.png", "missing_prediction_file")]


def test_annotation_files(spark, tmp_path):
    import json

    (tmp_path / "deep").mkdir()
    good = {"a 1": {"x": "p", "y": ["q", "r"]}, "b+2": {"x": ["p"]}, "ü": {}}
    for name, features in good.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"features": features, "note": "n"}, indent=2))
    (tmp_path / "cut.json").write_text('{"features": {"x": ')
    (tmp_path / "list.json").write_text("[]")
    (tmp_path / "bare.json").write_text("{}")
    (tmp_path / "deep" / "b+2.json").write_text(json.dumps({"features": {"x": "s"}}))
    (tmp_path / "ignored.txt").write_text("x")
    values, issues = files.annotation_files(spark, str(tmp_path))
    assert sorted(tuple(r) for r in values.collect()) == [("a 1", "x", "p"), ("a 1", "y", "q"), ("a 1", "y", "r"), ("b+2", "x", "p"), ("b+2", "x", "s")]
    assert sorted(tuple(r) for r in issues.collect()) == [("b+2", "repeated_target"), ("bare", "missing_features"), ("cut", "malformed_annotation"), ("list", "malformed_annotation")]


def test_late_rows_don_t_reopen_a_window(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", 1, 1.0), ("2024-01-01 03:00:00", "a", 1, 2.0)]
    d = spark.createDataFrame(rows, "ts string, event_type string, user_id int, value double").withColumn("ts", F.to_timestamp("ts"))
    d.write.parquet(str(tmp_path / "events.parquet"))
    out = attempts.drain(attempts.attempt_window(attempts.source(spark, str(tmp_path))), str(tmp_path / "out"))
    assert [r.attempts for r in out.collect()] == [1]


def test_interaction_against_newton(spark):
    import numpy as np

    rng = random.Random(5)
    rows = []
    for i in range(300):
        a, b, c = rng.randint(0, 1), rng.randint(0, 1), rng.choice("xyz")
        rows += [(int(rng.random() < 0.15 + 0.2 * a + 0.1 * b + 0.3 * a * b), a, b, c, i) for _ in range(3)]
    schema = "error int, a int, b int, c string, id int"
    got = diagnosis.interaction(spark.createDataFrame([*rows, (None, 1, 1, "x", 1)], schema), "error", "a", "b", ["c"], "id").first()

    y = np.array([r[0] for r in rows], float)
    x = np.array([[1, a, b, a * b, c == "y", c == "z"] for _, a, b, c, _ in rows], float)
    beta = np.zeros(6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        bread = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)
        beta = beta + bread @ x.T @ (y - p)
    u = ((y - p)[:, None] * x).reshape(300, 3, 6).sum(axis=1)
    se = (bread @ u.T @ u @ bread)[3, 3] ** 0.5
    assert (got.samples, got.decisions, got.estimable) == (300, 900, 1)
    assert got.log_odds == pytest.approx(beta[3], abs=1e-4)
    assert got.low == pytest.approx(math.exp(beta[3] - 1.959963984540054 * se), rel=1e-3)
    assert got.p_value == pytest.approx(math.erfc(abs(beta[3]) / se / 2**0.5), rel=1e-2, abs=1e-12)


def test_interaction_needs_errors_in_each_cell(spark):
    some = spark.createDataFrame([(0, 0, 0, "x", 1), (1, 1, 1, "x", 2)], "error int, a int, b int, c string, id int")
    for d in (some, some.limit(0)):
        got = diagnosis.interaction(d, "error", "a", "b", ["c"], "id").first()
        assert got.estimable == 0 and got.reason and got.log_odds is None


def test_nearest_of_a_group(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.1]), (4, None, [1.0, 0.0])], "id int, g string, v array<double>")
    own = similar.nearest(v.where("id = 1"), v, "id", "v", 1, groups=("g", "g", True)).first()
    other = similar.nearest(v.where("id = 1"), v, "id", "v", 1, groups=("g", "g", False)).first()
    assert (own.id, other.id) == (2, 3)
    assert similar.nearest(v.limit(0), v, "id", "v", 1).count() == 0


def test_protocol_delta_by_hand(spark):
    from quadrat.operators import agreement

    schema = "class_name string, sample_id string, field string, left string, right string"
    old = [("k", str(i), "f", "a", "a" if i < 50 else "b") for i in range(100)] + [("k", "alone", "f", "a", "a"), ("k", "0", "rare", "a", "unknown")]
    new = [("k", str(i), "f", "a", "a" if i < 90 else "unknown" if i > 97 else "b") for i in range(100)] + [("k", "0", "rare", "a", "a")]
    got = {r.field: r for r in agreement.protocol_delta(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "field").collect()}
    f, rare = got["f"], got["rare"]
    assert (f.n, f.old_known, f.old_agreement_pct, f.both_known_pct_delta, f.decision) == (100, 100, 50.0, -2.0, "promising_for_expansion")
    assert f.revised_agreement_pct == pytest.approx(9000 / 98) and f.agreement_low < f.agreement_pct_delta < f.agreement_high
    assert rare.old_agreement_pct is None and rare.decision == "insufficient_known_support"


def test_swaps_against_all_exchanges(spark):
    rng = random.Random(3)
    for _ in range(5):
        rows = {f"{i:02}": (rng.choice("uv"), frozenset(x for x in "abcdef" if rng.random() < 0.3)) for i in range(30)}
        picked = set(rng.sample(sorted(rows), 8))
        states = spark.createDataFrame([("k", i, "f", x) for i, (_, st) in rows.items() for x in sorted(st)], "class_name string, sample_id string, field string, value string")
        cells = spark.createDataFrame([("k", i, cell) for i, (cell, _) in rows.items()], "class_name string, sample_id string, cell string")
        chosen = spark.createDataFrame([(i,) for i in sorted(picked)], "sample_id string")

        names = sorted(set().union(*[x for _, x in rows.values()]))

        def judge(ids, names=names, rows=rows):
            n = [sum(x in rows[i][1] for i in ids) for x in names]
            met, full = sum(k > 0 for k in n) / len(n), sum(min(k / 3, 1) for k in n) / len(n)
            return met, full, max(0, 1 - met) + max(0, 0.9 - full) / 0.9, sum(math.log1p(min(k, 3)) for k in n) / len(n) / math.log1p(3)

        want = []
        while len(want) < 8:
            met, full, lack, use = judge(picked)
            if met >= 1 and full + 1e-12 >= 0.9:
                break
            best = []
            for o in picked:
                for i in set(rows) - picked:
                    if rows[o][0] != rows[i][0]:
                        continue
                    m, f, d, u = judge(picked - {o} | {i})
                    if (d < lack - 1e-12 or (abs(d - lack) <= 1e-12 and u > use + 1e-12)) and (met < 1 or m >= 1) and (full + 1e-12 < 0.9 or f + 1e-12 >= 0.9):
                        best.append((round(d, 10), -round(u, 10), o, i))
            if not best:
                break
            _, _, o, i = min(best)
            picked = picked - {o} | {i}
            want.append((o, i))
        got = selection.repair(states, cells, chosen, 8, 1.0, 0.9, 3, 8).orderBy("step").collect()
        assert [(r.outgoing, r.incoming) for r in got] == want
    assert selection.repair(states.limit(0), cells.limit(0), chosen.limit(0), 8, 1.0, 0.9, 3).count() == 0


def cheapest(cost):
    """Least total cost of giving each row of a small matrix a column of its own: dynamic programming over sets of columns."""
    best = {0: 0.0}
    for row in cost:
        now: dict = {}
        for used, total in best.items():
            for j, c in enumerate(row):
                if not used >> j & 1:
                    key = used | 1 << j
                    if total + c < now.get(key, math.inf):
                        now[key] = total + c
        best = now
    return min(best.values())


def test_auction_is_within_epsilon_of_the_optimum():
    import numpy as np

    rng = random.Random(3)
    for trial in range(60):
        need = [rng.randint(1, 3) for _ in range(rng.randint(1, 4))]
        room = [rng.randint(1, 3) for _ in range(rng.randint(1, 5))]
        while sum(room) < sum(need):
            room.append(rng.randint(1, 3))
        c = np.array([[rng.choice([0.0, 0.25, 0.5, rng.random()]) for _ in room] for _ in need])
        epsilon = 10.0 ** -rng.randint(2, 5)
        done = matching.Auction(lambda i, items, c=c: c[i, items], np.array(need), np.array(room), epsilon)
        held, used = [0] * len(need), [0] * len(room)
        for i, j, m in done.flows:
            held[i] += m
            used[j] += m
        assert held == need and all(u <= r for u, r in zip(used, room, strict=True))
        rows = [[c[i, j] for j, r in enumerate(room) for _ in range(r)] for i, n in enumerate(need) for _ in range(n)]
        best = cheapest(rows)
        assert best - 1e-9 <= done.total <= best + epsilon * sum(need) + 1e-9
        assert done.bound <= best + 1e-9 and done.total - done.bound <= epsilon * sum(need) + 1e-9


@pytest.mark.parametrize("grid", [0.0, 0.01])
def test_nearest_controls_cost_the_least(spark, grid):
    rng = random.Random(11)
    row = lambda i: (f"{i:03}", rng.choice(["p", "q", "q", None]), rng.choice([0.1, 0.2, 0.35, 0.5, 0.8, 0.0]), rng.choice("st"))
    cases, controls = [row(i) for i in range(26)], [row(i) for i in range(100, 120)]
    schema = "id string, block string, size double, g string"
    pairs, flows = matching.nearest_controls(spark.createDataFrame(cases, schema), spark.createDataFrame(controls, schema), "id", ["block"], "size", "g", grid=grid)
    got = pairs.collect()

    known = [r for r in cases + controls if r[1]]
    logs = [math.log(max(r[2], 1e-8)) for r in known]
    mean = sum(logs) / len(logs)
    std = (sum((x - mean) ** 2 for x in logs) / (len(logs) - 1)) ** 0.5
    cost = lambda a, b: abs(math.log(max(a[2], 1e-8)) - math.log(max(b[2], 1e-8))) / std + 0.25 * (a[3] != b[3])
    by_id = {r[0]: r for r in known}
    for block in "pq":
        left, right = [r for r in cases if r[1] == block], [r for r in controls if r[1] == block]
        few, many = sorted([left, right], key=len)
        mine = [r for r in got if by_id[r.case_id][1] == block]
        assert len(mine) == len(few) == len({r.case_id for r in mine}) == len({r.control_id for r in mine})
        for r in mine:
            assert by_id[r.control_id][1] == block and r.cost == pytest.approx(cost(by_id[r.case_id], by_id[r.control_id]), abs=1e-6)
        best = cheapest([[cost(a, b) for b in many] for a in few])
        assert best - 1e-6 <= sum(r.cost for r in mine) <= best + (grid + matching.EPSILON) * len(few) + 1e-6
    assert sum(r.m for r in flows.collect()) == len(got)
    nothing = spark.createDataFrame([], schema)
    assert matching.nearest_controls(nothing, nothing, "id", ["block"], "size", "g")[0].count() == 0


def test_ranks_keep_null_groups_and_values(spark):
    rows = [(1, 5.0, "a"), (1, 5.0, "b"), (1, 9.0, "c"), (None, 2.0, "d"), (None, 2.0, "e"), (None, 1.0, "f"), (2, None, "g")]
    d = spark.createDataFrame(rows, "g int, v double, id string")
    got = {r.id: r["rank"] for r in ranking.average_rank(d, "v", ["g"]).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0, "d": 2.5, "e": 2.5, "f": 1.0, "g": None}
    got = {r.id: (r["rank"], r.n) for r in ranking.ranked(d, ["g"], "v", "id", total="n").collect()}
    assert got == {"a": (1, 3), "b": (2, 3), "c": (3, 3), "d": (2, 3), "e": (3, 3), "f": (1, 3), "g": (1, 1)}
    assert ranking.five_tiers(d, "v", "id", ["g"]).count() == ranking.tiers_floor(d, "v", "id", ["g"]).count() == len(rows)


def test_ranks_over_many_ranges(spark):
    """Distinct values of one class lie in several ranges; ties and ranges carry over."""
    rng = random.Random(4)
    values = [rng.choice([rng.random(), 0.5, -1.0]) for _ in range(3000)]
    d = spark.createDataFrame([(i, "x", v) for i, v in enumerate(values)], "id int, g string, v double").repartition(6)
    order = sorted(values)
    from bisect import bisect_left, bisect_right

    want = {i: (bisect_left(order, v) + 1 + bisect_right(order, v)) / 2 for i, v in enumerate(values)}
    assert {r.id: r["rank"] for r in ranking.average_rank(d, "v", ["g"]).collect()} == want


def test_a_true_tier_gap_is_found(spark):
    from quadrat.plans.sampling import tier_gap_test

    # tier 5 is always wrong, the rest always right: ten draws can't give a p under 1/11
    t = spark.createDataFrame([("a", 1 + i // 40, float(i // 40 != 4)) for i in range(200)], "class_name string, tier int, y double")
    got = tier_gap_test(t).first()
    assert (got.observed, got.replicates, got.p) == (-1.0, 10_000, round(1 / 10_001, 6))
    assert -0.25 < got.low < -0.1 and 0.1 < got.high < 0.25


def test_random_tiers_have_the_spread_of_a_permutation(spark):
    rng = random.Random(3)
    values = [0.0] * 30 + [0.5] * 20 + [1.0] * 53
    t = spark.createDataFrame([("a", v, values.count(v)) for v in (0.0, 0.5, 1.0)], "g string, v double, n long")
    got = [r.d for r in stats.random_tier_gaps(t, "g", "v", "n", 4000).collect()]
    want = []
    for _ in range(4000):
        rng.shuffle(values)
        want.append(sum(values[-20:]) / 20 - sum(values[:21]) / 21)
    spread = lambda x: math.sqrt(sum(v * v for v in x) / len(x))
    assert len(set(got)) > 50 and abs(sum(got) / 4000) < 0.01 and abs(spread(got) / spread(want) - 1) < 0.06


def test_bootstrap_sums_have_mean_and_spread_of_poisson_weights(spark):
    t = spark.createDataFrame([(0, 1, 40), (1, 1, 60)], "k int, n int, images long")
    got = stats.bootstrap_sums(t, ["k", "n"], "images", 4000).collect()
    k, n = [r.k for r in got], [r.n for r in got]
    mean = sum(k) / 4000
    assert abs(mean - 60) < 0.6 and abs(sum(n) / 4000 - 100) < 0.8 and abs(sum((x - mean) ** 2 for x in k) / 4000 - 60) < 6
    assert [tuple(r) for r in got] == [tuple(r) for r in stats.bootstrap_sums(t, ["k", "n"], "images", 4000).collect()]


@pytest.mark.parametrize("n", [1, 2, 20, 101])
def test_bootstrap_medians_spread_as_resampled_rows_do(spark, n):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.round(rng.lognormal(size=n), 1)  # with ties
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
    m = {r.rep: r.m for r in stats.bootstrap_median(d, "v", 4000).collect()}
    assert m.pop(0) == pytest.approx(np.median(x)) and sorted(m) == list(range(1, 4001))
    got, want = np.array(list(m.values())), np.median(x[rng.integers(0, n, (4000, n))], axis=1)
    spread = max(want.std(), 1e-9)
    assert abs(got.mean() - want.mean()) < 0.1 * spread and 0.93 < (got.std() + 1e-9) / spread < 1.07 or n == 1
    for q in (0.05, 0.5, 0.95):
        assert np.quantile(got, q) == pytest.approx(np.quantile(want, q), abs=0.25 * spread)
    assert stats.bootstrap_median(d.limit(0), "v", 10).collect() == []


def test_replicates_are_the_references(spark):
    from quadrat.plans import statistics
    from quadrat.plans.panels import Panels

    p = Panels(spark, "/root/testdata/sf0.001")
    assert statistics.st_contrast_record(p).first().finite == statistics.REPLICATES == 10_000
    assert all(r.p > 0 for r in statistics.st_paired_bootstrap_models(p).collect())


def test_the_rule_accepts_and_refuses_planted_copies(spark):
    from quadrat.plans import similarity
    from quadrat.plans.panels import Panels

    p = Panels(spark, "/root/testdata/sf0.001")
    turn = lambda b: (b - 1_000_000) // 10 % len(similarity.CASES)
    met = {}
    for r in similarity.sim_hamming_pairs_64(p).collect():
        assert r.b == r.a + 1_000_000 and r.distance == similarity.CASES[turn(r.b)][0]
        met.setdefault(turn(r.b), set()).add(r.distance)
    assert sorted(met) == [0, 1, 2, 3, 4, 5, 6]  # nine bits are out of reach
    ok = {turn(r.b) for r in similarity.sim_cosine_confirm_64(p).collect()}
    # 4 bits at .98 and 7 and 8 bits at .995 pass; 4 bits under .98 and 5 and 8 bits under .995 don't
    assert ok == {0, 1, 4, 5}


def test_hamming_pairs_of_64_bits_within_8(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    flip = lambda x, k: x ^ sum(1 << i for i in rng.sample(range(64), k))
    rows = list(enumerate([*base, *(flip(x, k % 11) for k, x in enumerate(base))]))
    d = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "id long, h long")
    got = {(r.a, r.b, r.distance) for r in similar.hamming_pairs(d, None, "id", "h", 8).collect()}
    want = {(a, b, bin(x ^ y).count("1")) for a, x in rows for b, y in rows if a < b and bin(x ^ y).count("1") <= 8}
    assert got == want and {7, 8} <= {n for _, _, n in got}
    for bands in (2, 3, 5, 9):  # every layout finds them, in one way a band
        found = similar.hamming_pairs(d, None, "id", "h", 8, bands=bands).collect()
        assert len(found) == len(want) and {tuple(r) for r in found} == want
    left, right = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    across = {tuple(r) for r in similar.hamming_pairs(left, right, "id", "h", 8).collect()}
    assert across == {(a, b, bin(x ^ y).count("1")) for a, x in rows for b, y in rows if a % 2 == 0 and b % 2 == 1 and bin(x ^ y).count("1") <= 8}


def test_candidates_of_the_hamming_index_stay_few(spark):
    """Rows that meet in the index, for a hash: a few at 20,000 hashes, and the layout widens its bands before they are many."""
    rng = random.Random(6)
    rows = [(rng.getrandbits(64) - (1 << 63),) for _ in range(20_000)]
    h = spark.createDataFrame(rows, "h long")
    a, b = similar.banded(h, "h", "a", 3, 1), similar.banded(h, "h", "b", 3, 1)
    met = a.join(b, ["part", "bits"]).where("ha < hb and (nb = 0 or (na = 1 and mosta < leastb))").count()
    assert met <= 6 * len(rows)
    strangers = lambda n, bands: bands * n * sum(math.comb(64 // bands, e) for e in range(8 // bands + 1)) / 2 ** (64 // bands)
    assert all(strangers(n, similar.layout(n, 8)) < 800 for n in (10**5, 10**6, 10**7))
    assert similar.layout(10**5, 8) < 4 and similar.layout(10**7, 8) == 2


def test_errors_are_clustered_inside_their_class(spark):
    from quadrat.plans.similarity import error_clusters

    # nine errors of a in three directions, one of b in a direction of a
    far = lambda i: [float(j == i % 3) for j in range(3)]
    rows = [("a", i, [x + 0.01 * i / 9 for x in far(i)]) for i in range(9)] + [("b", 50, far(0))]
    got = {r.vec_id: (r.class_name, r.cluster) for r in error_clusters(spark.createDataFrame(rows, "class_name string, vec_id long, v array<double>")).collect()}
    assert sorted(got) == [*range(9), 50] and got[50] == ("b", 0)
    assert len({got[i] for i in range(9)}) == 3 and all(got[i] == got[i % 3] for i in range(9))


def test_more_starts_never_raise_the_inertia(spark):
    import numpy as np

    from quadrat.operators import clusters

    rng = np.random.default_rng(4)
    rows = [(g, i, (rng.normal(size=3) + 4 * rng.integers(0, 2, 3)).tolist()) for g in "ab" for i in range(120)] + [("c", i, [1.0, 2.0, 3.0]) for i in range(5)]
    table = spark.createDataFrame(rows, "`group` string, id long, v array<double>").repartition(3)
    k = {"a": 6, "b": 4, "c": 3}
    centres, inertia = clusters.fit(table, k, starts=8)
    few, less = clusters.fit(table, k, starts=3)
    best = lambda found, g: min(x for (h, _), x in found.items() if h == g)
    assert all(best(inertia, g) <= best(less, g) + 1e-9 for g in k) and {key: inertia[key] for key in less} == pytest.approx(less)
    assert len({round(x, 6) for (g, _), x in inertia.items() if g == "a"}) > 1  # starts do differ
    for (g, _), c in centres.items():  # settled: every centre is the mean of what is nearest to it
        v = np.array([x for h, _, x in rows if h == g])
        d = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert len(c) == (1 if g == "c" else k[g])  # equal rows give one centre
        shift = sum(((v[near == j].mean(axis=0) - c[j]) ** 2).sum() for j in set(near))
        assert shift <= 2 * clusters.SHIFT * v.var(axis=0).mean() + 1e-12
    for (g, s), x in inertia.items():
        v = np.array([y for h, _, y in rows if h == g])
        assert x == pytest.approx(((v[:, None] - centres[g, s][None]) ** 2).sum(axis=2).min(axis=1).sum())


def test_clusters_of_odd_rows(spark):
    from quadrat.operators.clusters import clusters

    rows = [("a", 1, [1.0, 0.0]), ("a", 2, None), (None, 3, [1.0, 0.0]), ("b", None, [1.0, 0.0]), ("d", 4, [0.0, 0.0]), ("d", 5, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "`group` string, id long, v array<double>")
    assert sorted(tuple(r) for r in clusters(table).collect()) == [("a", 1, 0), ("d", 4, 0), ("d", 5, 0)]
    assert clusters(table.limit(0)).collect() == []


def test_cluster_breadth_by_hand(spark):
    from quadrat.plans.diagnosis import cluster_breadth

    c = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 2)], "class_name string, vec_id long, cluster int")
    order = spark.createDataFrame([(3, 1), (9, 2), (2, 3), (1, 5)], "vec_id long, rank int")
    got = {r.budget: (r.met, r.clusters, r.breadth) for r in cluster_breadth(c, order, (1, 3, 9)).collect()}
    assert got == {1: (1, 3, 0.333333), 3: (2, 3, 0.666667), 9: (2, 3, 0.666667)}


def test_pair_gap_and_cluster_breadth_are_registered():
    from quadrat.plans import catalog

    assert {"dx_pair_gap", "dx_cluster_breadth"} <= set(catalog.queries())


def test_the_manifest_covers_the_folder(spark):
    from quadrat.plans.panels import Panels
    from quadrat.plans.validation import dq_manifest_diff

    got = {r.name: r.status for r in dq_manifest_diff(Panels(spark, "/root/testdata/sf0.001")).collect()}
    bad = {"absent.parquet": "missing", "region.parquet": "mismatched", "nation.parquet": "mismatched"}
    assert {k: v for k, v in got.items() if v != "valid"} == bad and len(got) == 15 and got["lineitem.parquet"] == "valid"


def test_panels_of_a_target_meet_without_another_shuffle(spark, capsys):
    """What goes by sample_id is dealt once, as lineitem is read."""
    from quadrat.operators import agreement, metrics
    from quadrat.plans.panels import FIELDS, Panels

    p = Panels(spark, "/root/testdata/sf0.001")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (agreement.wide_pairs(p.targets, p.second, FIELDS), metrics.error_ledger(p.facts, 3)):
            df.explain()
            moved = [x for x in capsys.readouterr().out.splitlines() if "Exchange" in x]
            assert moved and all("hashpartitioning(concat_ws(" in x for x in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_wide_pairs_equal_pairs(spark):
    from quadrat.operators import agreement
    from quadrat.operators.states import explode_fields

    a = spark.createDataFrame([("A", "s1", "x", None), ("B", "s2", "unknown", "y"), (None, "s3", "x", "y"), ("A", "s4", "x", "y")], "class_name string, sample_id string, f string, g string")
    b = spark.createDataFrame([("A", "s1", "z", "y"), ("B", "s2", "x", "y"), (None, "s3", "x", "y"), ("A", "s5", "x", "y")], a.schema)
    want = agreement.pairs(explode_fields(a, ["f", "g"], ()), explode_fields(b, ["f", "g"], ()))
    got = agreement.wide_pairs(a, b, ["f", "g"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hash_ranks_and_tiers_equal_those_of_a_whole_sort(spark):
    """Rows are counted or cut by their hash first; also where no hash is low enough."""
    d = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("id"), F.lit("same").alias("one")).withColumn("g", F.when(F.col("g") < 2, F.col("g")))
    key = F.sha2(F.concat_ws(":", F.lit("5"), "id"), 256)
    rows = lambda df: sorted((str(r[0]), *r[1:]) for r in df.collect())
    want = ranking.ranked(d, ["g"], key, "id")
    assert rows(ranking.hash_ranked(d, ["g"], "id", F.lit("5"), F.col("id"))) == rows(want)
    assert rows(ranking.hash_first(d, ["g"], 20, F.lit("5"), F.col("id"))) == rows(want.where("rank <= 20"))
    assert rows(ranking.hash_first(d, ["g"], 2000, F.lit("5"), F.col("id"))) == rows(want)
    tiers = ranking.five_tiers(d.withColumn("_key", key), "_key", "id", ["g"]).drop("_key")
    assert rows(ranking.hash_tiers(d, ["g"], "id", F.lit("5"), F.col("id"))) == rows(tiers)
    assert ranking.hash_first(d, ["g"], 20, F.lit("5"), F.col("one")).count() == 60


def test_signatures_without_a_field_come_from_the_whole_ones(spark):
    """F8: the table is folded once, not once for each field."""
    rows = [("A", f"s{i:03}", "all", sorted([f"f={i % 3}", f"g={i % 2}"])) for i in range(90)]
    d = spark.createDataFrame(rows, "class_name string, sample_id string, cell string, states array<string>")
    got = selection.without(selection.folded(d, 4), "f", 4)
    want = selection.folded(d.withColumn("states", F.filter("states", lambda s: ~F.startswith(s, F.lit("f=")))), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_near_duplicates_plan_their_hashes_once(spark):
    from quadrat.plans import similarity
    from quadrat.plans.panels import Panels

    p = Panels(spark, "/root/testdata/sf0.001")
    for q in (similarity.sim_hamming_pairs_64, similarity.sim_hamming_classes_64, similarity.sim_duplicate_status_64, similarity.sim_cosine_confirm_64):
        plan = q(p)._jdf.queryExecution().optimizedPlan().toString()
        # the signs are 64 shifts each time that they are planned
        assert "shiftleft" not in plan and len(plan) < 30_000


def test_rows_of_a_target_replace_its_facts(spark, capsys):
    """What goes by target neither joins nor sorts the facts."""
    from quadrat.operators import agreement, metrics
    from quadrat.plans.panels import FIELDS, RUNS, Panels

    p = Panels(spark, "/root/testdata/sf0.001")
    led = metrics.run_ledger(p.runs, RUNS, 3)
    pairs, wide = agreement.row_pairs(p.both, FIELDS, "second_"), agreement.wide_pairs(p.targets, p.second, FIELDS)
    for df in (led, pairs, p.facts_with("scale"), p.sets_with("scale")):
        df.explain()
        assert "Join" not in (out := capsys.readouterr().out) and out.count("Exchange") == 1
    assert led.exceptAll(metrics.error_ledger(p.facts, 3).select(*led.columns)).isEmpty() and pairs.exceptAll(wide).isEmpty()


def test_tiers_from_counts_equal_those_of_all_ranks(spark, monkeypatch):
    """rows of a score inside one tier aren't ranked."""
    from quadrat.operators import ranking

    rng, sizes = random.Random(3), []
    d = spark.createDataFrame([(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, 2.0, 7.5]), i) for i in range(200)], "g string, s double, i long")
    real = ranking.ranked
    monkeypatch.setattr(ranking, "ranked", lambda df, *a, **k: (sizes.append(df.count()), real(df, *a, **k))[1])
    few = sorted(map(tuple, ranking.five_tiers(d, "s", "i", ["g"]).collect()), key=str)
    monkeypatch.setattr(ranking, "FEW", 0)
    assert few == sorted(map(tuple, ranking.five_tiers(d, "s", "i", ["g"]).collect()), key=str)
    assert sizes[0] < sizes[1] == 200


def test_record_issues_move_a_record_once(spark, capsys):
    """one shuffle of the records and one of the manifest."""
    from quadrat.sources import files

    row = "model string, member string, index long, prediction string, correct boolean, logits array<double>, error string, broken string"
    r = [("m", "a", 1, "x", True, [2.0, 1.0], None, None), ("m", "a", 1, "x", False, [2.0, 1.0], "e", None), ("m", "b", 9, "y", True, [1.0], None, None), ("m", "other", 1, "x", True, None, None, None), ("m", None, None, None, None, None, None, "{")]
    m = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "y")], "member string, index long, class_id string")
    got = files.prediction_issues(spark.createDataFrame(r, row), m, ["x", "y"], ["m", "n"], ["n"])
    want = [("m", "a", "inference_error"), ("m", "a", "historical_correctness_mismatch"), ("m", "a", "duplicate_prediction"), ("m", "b", "invalid_logits"), ("m", "b", "manifest_index_mismatch"), ("m", "c", "missing_prediction"), ("m", None, "malformed_record")]
    want += [("n", k, "missing_prediction_file") for k in "abc"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    capsys.readouterr()
    files.prediction_issues(spark.createDataFrame(r, row), m, ["x", "y"], ["m", "n"], ["n"]).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def dealt_by(df, capsys):
    """The lines of a plan in which rows are dealt by target."""
    capsys.readouterr()
    df.explain()
    return [x for x in capsys.readouterr().out.splitlines() if "Exchange" in x and any(c in x for c in ("sample_id", "l_orderkey", "concat_ws"))]


@pytest.mark.parametrize("few", [0, 20_000])
def test_spread_targets_equal_the_dealt_ones(spark, monkeypatch, tmp_path, few):
    """Only rows whose keys are there again meet; with many of those all rows do."""
    from quadrat.plans import panels

    monkeypatch.setattr(panels, "FEW", few)
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    li.unionByName(li.where("l_orderkey % 50 = 0").withColumn("l_extendedprice", F.col("l_extendedprice") - F.col("l_linenumber") % 3 + 1)).write.parquet(f"{tmp_path}/lineitem.parquet")
    p = panels.Panels(spark, str(tmp_path))
    a, b = p.spread.targets, p.targets
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == li.select(*panels.KEYS).distinct().count()


def test_set_disagreements_deals_no_target(spark, capsys):
    """fields of a target lie in one row."""
    from quadrat.plans import windows
    from quadrat.plans.panels import Panels

    df = windows.set_disagreements(Panels(spark, "/root/testdata/sf0.001"))
    assert not dealt_by(df, capsys)


def test_shuffles_of_a_checkpoint_are_gone(spark):
    """Each pass over a large table left its shuffle files until the driver's garbage was collected."""
    from quadrat.sources.shared import ready

    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffles = lambda: {str(x) for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffles()
    df = ready(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("g")).count())
    until = time.time() + 10
    while (left := [x for x in shuffles() - before if x.endswith(".data")]) and time.time() < until:
        time.sleep(0.2)
    assert not left and df.count() == 7


def test_protocol_delta_query_joins_no_pairs(spark, capsys):
    """both protocols of a pair lie in one row, and pairs are counted before anything else."""
    from quadrat.plans import agreement
    from quadrat.plans.panels import Panels

    df = agreement.ag_protocol_delta(Panels(spark, "/root/testdata/sf0.001"))
    assert not dealt_by(df, capsys)
    df.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out


@pytest.mark.parametrize("near", [0, 40, 100_000])
def test_tiers_from_keys_at_the_limits(spark, monkeypatch, near):
    """the rows of a score that a limit cuts are neither ranked nor moved; equal keys and nulls still are dealt out evenly."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1.0, 7.5]), f"{rng.choice(['', '1', '77-7'])}{rng.randrange(10**6)}-{i}" if i else None) for i in range(400)] + [("c", 1.0, str(i)) for i in range(3)]
    d = spark.createDataFrame(rows, "g string, s double, i string")
    monkeypatch.setattr(ranking, "NEAR", near)
    real, calls = ranking.ranked, []
    monkeypatch.setattr(ranking, "ranked", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    got = sorted(map(tuple, ranking.five_tiers(d, "s", "i", ["g"]).collect()), key=str)
    assert not calls
    monkeypatch.setattr(ranking, "FEW", 0)
    assert got == sorted(map(tuple, ranking.five_tiers(d, "s", "i", ["g"]).collect()), key=str)
    monkeypatch.setattr(ranking, "FEW", 100)
    same = d.withColumn("i", F.lit("same"))
    sizes = sorted(r["count"] for r in ranking.five_tiers(same.where("g = 'a'"), "s", "i", ["g"]).groupBy("tier").count().collect())
    assert len(sizes) == 5 and sizes[-1] - sizes[0] <= 1


def test_random_strata_null_joins_no_facts(spark):
    """a target's share of correct runs comes from its row."""
    from quadrat.plans import sampling as plans
    from quadrat.plans.panels import Panels
    from quadrat.plans.windows import tiers

    p, seen = Panels(spark, "/root/testdata/sf0.001"), {}
    e = p.facts.groupBy("sample_id").agg(F.avg("correct").alias("y"))
    want = plans.tier_gap_test(tiers(p).select("sample_id", "class_name", "tier").join(e, "sample_id"), 50).first()
    real = plans.tier_gap_test
    try:
        plans.tier_gap_test = lambda t: (seen.update(plan=t._jdf.queryExecution().optimizedPlan().toString()), real(t, 50))[1]
        assert plans.smp_random_strata_null(p).first() == want
    finally:
        plans.tier_gap_test = real
    assert "Window" not in seen["plan"] and "Generate" not in seen["plan"]


def test_risk_shift_reads_counts_of_scores(spark, monkeypatch):
    """errors and ranks come from the pairs of scores, and no row is ranked."""
    from quadrat.plans import agreement
    from quadrat.plans.panels import Panels

    sizes, real = [], ranking.average_rank
    monkeypatch.setattr(ranking, "average_rank", lambda d, *a, **k: (sizes.append(d.count()), real(d, *a, **k))[1])
    monkeypatch.setattr(ranking, "ranked", None)
    agreement.ag_risk_shift(Panels(spark, "/root/testdata/sf0.001"))
    assert len(sizes) == 2 and max(sizes) < 1000


def test_records_know_their_model_without_a_path(spark, tmp_path, capsys):
    """the model is a constant of its file's scan, whatever its name; before, an expression was matched for each line."""
    (tmp_path / "m 1.jsonl").write_text('{"member": "a", "index": 1}\n{broken\n')
    (tmp_path / "n.jsonl.gz").mkdir()
    (tmp_path / "n.jsonl.gz" / "part-0.jsonl").write_text('{"member": "b", "index": "2", "logits": [1, 2]}\n')
    rows = files.read_predictions(spark, str(tmp_path), ["m 1", "n", "absent"])
    got = sorted(map(tuple, rows.select("model", "member", "index", "broken").collect()), key=str)
    assert got == [("m 1", "a", 1, None), ("m 1", None, None, "{broken"), ("n", "b", 2, None)]
    rows.explain()
    assert "regexp" not in capsys.readouterr().out
    assert files.read_predictions(spark, str(tmp_path), ["absent"]).columns == rows.columns
