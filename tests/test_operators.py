"""Invariants over the test tables, literal fixtures, empty input, plan shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.operators import audit as aud
from tickframe.operators import breach as bre
from tickframe.operators import classify as cls
from tickframe.operators import context as ctx
from tickframe.operators import documented as doc
from tickframe.operators import ingest as ing
from tickframe.operators import insights as ins
from tickframe.operators import monitoring as mon
from tickframe.operators import scorecard as sco
from tickframe.operators import svm
from tickframe.operators import text as txt
from tickframe.operators import trends as tr
from tickframe.plans import filters as flt
from tickframe.plans import ordered
from tickframe.plans import shape
from tickframe.sources import testtables as tt

from .conftest import SF


def total(df, c):
    return df.agg(F.sum(c)).first()[0]


def test_pivot_totals_equal_rows(incidents):
    n = incidents.count()
    for rows in (mon.by_group(incidents), mon.priority_heatmap(incidents)):
        assert total(rows, "total") == n
    assert total(tr.volume(incidents), "count") == n
    assert total(tr.heatmap_dow_hour(incidents), "count") == n


def test_met_plus_breached(incidents):
    r = mon.sla_kpi(incidents).first()
    assert r["met"] + r["breached"] == r["total"] == incidents.count()


def test_top_plus_others_is_all(incidents):
    n = incidents.count()
    assert total(mon.heatmap_top_others(incidents), "total") == n
    assert total(tr.volume_by_group(incidents), "count") == n
    assert total(tr.series_top_n(incidents), "count") == n


def test_buckets_plus_outside_is_all(snapshot):
    inside = total(bre.elapsed_distribution(snapshot), "count")
    outside = snapshot.where("business_elapsed_percentage <= 0 OR business_elapsed_percentage > 200").count()
    assert inside + outside == snapshot.count()


def test_date_to_includes_next_midnight(spark):
    df = spark.createDataFrame([("a", "2026-01-02 00:00:00"), ("b", "2026-01-02 00:00:01"), ("c", "2026-01-01 10:00:00")],
                               "n string, t string").withColumn("created", F.col("t").cast("timestamp"))
    assert sorted(r["n"] for r in flt.Filters(date_to="2026-01-01").apply(df).collect()) == ["a", "c"]


def test_org_filter_is_or_and_incident_filter_is_and(incidents, snapshot, spark):
    org = tt.org_map(spark, SF)
    either = flt.filter_org(snapshot, org, towers=["ASIA"], sdms=["SDM_3"])
    towers = {r["assignment_group"]: (r["tower"], r["sdm"]) for r in org.collect()}
    want = [r for r in snapshot.select("assignment_group").collect()
            if towers[r[0]][0] == "ASIA" or towers[r[0]][1] == "SDM_3"]
    assert either.count() == len(want)
    both = flt.apply_filters(incidents, {"towers": ["ASIA"], "sdms": ["SDM_3"]})
    assert both.where("tower <> 'ASIA' OR sdm <> 'SDM_3'").count() == 0
    assert flt.filter_org(snapshot, org, towers=["nowhere"]).count() == 0
    assert flt.filter_org(snapshot, org).count() == snapshot.count()


def test_search_literal_and_regex(incidents):
    assert flt.filter_search(incidents, "^INC00000000[12]$").count() == 2
    assert flt.filter_search(incidents, "^INC", literal=True).count() == 0


def test_empty_input_gives_one_row(incidents, snapshot):
    none, no_snap = incidents.where("false"), snapshot.where("false")
    assert mon.kpis(none).first()["total_incidents"] == 0
    assert mon.kpis(none).first()["sla_compliance_pct"] == 0
    assert bre.kpis(no_snap, tt.AS_OF).first()["breached_pct"] is None
    assert bre.kpi_scorecard(no_snap, tt.AS_OF).count() == 5
    assert bre.on_hold_summary(no_snap, tt.AS_OF).first()["total_on_hold"] == 0
    assert sco.summary(none, tt.AS_OF).count() == 12
    assert tr.forecast(none).count() == 0
    assert {r["id"] for r in ins.monitoring(none).collect()} == {"sla_compliance", "critical_backlog", "on_hold"}
    assert ins.trends(none).count() == 0
    assert ctx.facts(none).count() == 0


def test_forecast_fit(spark):
    counts = [3, 5, 4, 8, 9]
    rows = [(f"2026-0{i + 1}", j) for i, c in enumerate(counts) for j in range(c)]
    df = spark.createDataFrame(rows, "month string, j int")
    got = [r for r in tr.forecast(df, 2).collect() if r["type"] == "forecast"]
    slope, intercept = 1.6071782997, 2.5337413167
    assert [r["period"] for r in got] == ["2026-06", "2026-07"]
    assert [r["count"] for r in got] == [round(intercept + slope * x) for x in (5, 6)]
    assert got[0]["ci_upper"] - got[0]["count"] == round(0.12 * got[0]["count"])
    assert tr.forecast(df.where("month <= '2026-02'")).count() == 2


def test_dedup_last_wins_and_lists_removed(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("b", 1, "q")], "number string, _seq int, v string")
    assert {r["number"]: r["v"] for r in ing.dedup_keep_last(df).collect()} == {"a": "z", "b": "q"}
    assert [tuple(r) for r in ing.dedup_removed(df).collect()] == [("a", 2)]


def test_dedup_limits_groups_before_the_shuffle(spark):
    plan = ing.dedup_keep_last(tt.ticket_updates(spark, SF), order=tt.UPDATE_ORDER)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_split_known_trims_keys(spark):
    new = spark.createDataFrame([(" a ", 1), ("b", 2), (None, 3)], "number string, v int")
    old = spark.createDataFrame([("a",), ("c",)], "number string")
    fresh, known = ing.split_known(new, old)
    assert sorted(r["v"] for r in fresh.collect()) == [2, 3]
    assert [r["v"] for r in known.collect()] == [1]
    m = ing.merge_incidents(new, old).first()
    assert (m["records_imported"], m["duplicates_skipped"], m["total_in_system"]) == (2, 1, 4)


def test_link_without_key_column(spark, incidents):
    rows = spark.createDataFrame([(1, 2.0)], "id int, score double")
    r = ing.link_counts(rows, incidents).first()
    assert (r["records_imported"], r["records_merged"], r["validation_warnings"]) == (1, 0, 1)


def test_audit_verdicts(spark):
    rows = [("a", 1, "Total outage for all users"), ("b", 1, "senior management asks"), ("c", 1, "printer"),
            ("d", 2, "significant delay, many users"), ("e", 2, "question: how to do it"), ("f", 2, "printer"),
            ("g", 3, "anything")]
    df = spark.createDataFrame(rows, "number string, priority int, short_description string") \
        .withColumn("service_offering", F.lit(None).cast("string"))
    audited = aud.rule_audit(df)
    got = {r["number"]: (r["verdict"], r["suggested_priority"], r["confidence"]) for r in audited.collect()}
    assert got == {"a": ("CORRECT", 1, 0.65), "b": ("RECLASSIFY", 2, 0.6), "c": ("RECLASSIFY", 3, 0.55),
                   "d": ("CORRECT", 2, 0.65), "e": ("RECLASSIFY", 4, 0.6), "f": ("RECLASSIFY", 3, 0.55)}
    s = aud.summary(audited).first()
    assert (s["total_audited"], s["correctly_classified"], s["should_escalate"], s["should_downgrade"]) == (6, 2, 0, 4)


def test_audit_sample_quota(incidents):
    def sampled(df):
        return {r["priority"]: r["count"] for r in aud.sample(df).groupBy("priority").count().collect()}

    assert sampled(incidents) == {1: 5, 2: 15}
    two = [r["number"] for r in incidents.where("priority = 1").limit(2).collect()]
    few = incidents.where((F.col("priority") == 2) | F.col("number").isin(two))
    assert sampled(few) == {1: 2, 2: 18}


def brute_similar(queries, corpus, k):
    """Cosine of sublinear TF-IDF over unigrams and bigrams, by plain loops."""
    import re

    def terms(t):
        w = re.findall(r"[^\W]{2,}", t.lower())
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    docs = {d: terms(t) for d, t in corpus}
    df = {}
    for ws in docs.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    n = len(docs)

    def vec(ws):
        v = {w: (1 + math.log(ws.count(w))) * (math.log((1 + n) / (1 + df[w])) + 1) for w in set(ws) if w in df}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    vecs = {d: vec(ws) for d, ws in docs.items()}
    out = set()
    for q, t in queries:
        qv = vec(terms(t))
        s = sorted(((-round(sum(x * dv.get(w, 0) for w, x in qv.items()), 9), d) for d, dv in vecs.items()))
        out |= {(q, d, i + 1) for i, (x, d) in enumerate(s[:k]) if -x >= 0.05}
    return out


def test_similar_equals_brute_force(spark):
    corpus = [(1, "printer is broken on floor two"), (2, "vpn does not connect"), (3, "vpn connect error on laptop"),
              (4, "laptop screen broken"), (5, "new user setup"), (6, "vpn does not connect")]
    queries = [(10, "my vpn does not connect"), (11, "broken laptop screen"), (12, "zzz"), (13, "user of printer")]
    got = txt.similar(spark.createDataFrame(queries, "q int, text string"), spark.createDataFrame(corpus, "d int, text string"),
                      "q", "d", k=3)
    assert {(r["q"], r["d"], r["rank"]) for r in got.collect()} == brute_similar(queries, corpus, 3)


def test_similar_matches_rare_terms_only(spark):
    """Candidates leave out common terms, lose no pair, and are far fewer than all pairs that share a term."""
    rng = random.Random(1)
    common, rare = [f"c{i}" for i in range(4)], [f"r{i}" for i in range(3000)]
    text = lambda: " ".join(rng.choice(common) if rng.random() < .6 else rng.choice(rare) for _ in range(60))
    corpus, queries = [(i, text()) for i in range(150)], [(i, text()) for i in range(20)]
    corpus += [(1000 + 10 * i + j, t + " " + text()) for i, t in queries for j in range(3)]  # three that resemble each
    c, q = (spark.createDataFrame(rows, "k int, text string") for rows in (corpus, queries))
    asked, doc = txt._weighted(q.withColumnRenamed("k", "asked"), c, "asked", "k", "text", None)
    scores = {(r["_q"], r["k"]): r["s"] for r in doc.join(asked, "term").groupBy("_q", "k").agg(F.sum(F.col("qw") * F.col("dw")).alias("s")).collect()}
    fixed = asked.select("_q", F.lit(0.4).alias("least")).distinct()
    pairs = {tuple(r) for r in txt.candidates(asked, doc, "k", fixed).collect()}
    assert {p for p, s in scores.items() if s >= 0.4} <= pairs and len(pairs) < len(scores) / 2
    # The least score of the k-th best text leaves out no text of the first k, and nearly all others.
    least = txt.least_scores(asked, doc, "k", 3, 0.05)
    kth = {i: sorted((s for (x, _), s in scores.items() if x == i), reverse=True)[2] for i, _ in queries}
    assert all(0.05 <= r["least"] <= kth[r["_q"]] + 1e-6 for r in least.collect()) and least.count() == len(queries)
    pairs = {tuple(r) for r in txt.candidates(asked, doc, "k", least).collect()}
    assert {p for p, s in scores.items() if s >= kth[p[0]]} <= pairs and len(pairs) < 0.05 * len(corpus) * len(queries)
    got = txt.similar(q.withColumnRenamed("k", "asked"), c, "asked", "k", k=3)
    assert {(r["asked"], r["k"], r["rank"]) for r in got.collect()} == brute_similar(queries, corpus, 3)


def test_similar_looks_up_equal_texts_once(spark, monkeypatch):
    """Copies on both sides, in many small cells: the same rows as brute force, and no cell gives more than k texts a query."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(["ring", "bolt", "gear", "rod", "nut", "cap"]) for _ in range(n))
    corpus = [(i, t) for i, t in enumerate([text(3) for _ in range(40)] * 6)] + [(900, "")]
    queries = [(i, t) for i, t in enumerate([text(4) for _ in range(8)] * 5)]
    c, q = spark.createDataFrame(corpus, "d int, text string"), spark.createDataFrame(queries, "q int, text string")
    once, members = txt.representatives(c, "d", "text")
    assert once.count() == len({t for _, t in corpus}) and once.agg(F.sum("copies")).first()[0] == len(corpus) == members.count()
    monkeypatch.setattr(txt, "CELL", 60)
    got = txt.similar(q, c, "q", "d", k=4)
    assert sorted((r["q"], r["d"], r["rank"]) for r in got.collect()) == sorted(brute_similar(queries, corpus, 4))


def test_similar_with_keys_that_repeat_or_are_null(spark):
    """A row without a key counts as a text and is never found; rows of one key make one text."""
    rows = [(1, "red ring"), (1, "red ring"), (2, "red ring"), (3, "blue bolt"), (None, "red ring"), (None, "old gear")]
    c = spark.createDataFrame(rows, "d int, text string")
    q = spark.createDataFrame([(1, "red ring"), (None, "blue bolt"), (2, None)], "q int, text string")
    got = {(r["q"], r["d"]): r["score"] for r in txt.similar(q, c, "q", "d", k=5).collect()}
    assert got == {(1, 1): round(math.sqrt(2), 9), (1, 2): 1.0}
    none = txt.similar(q, c, "q", "d", k=5, max_terms=1)
    assert {(r["q"], r["d"]) for r in none.collect()} == {(1, 1), (1, 2)}


def test_nearest_scores_few_texts_to_the_end():
    """A text that holds a query's rare terms prunes; the best texts are those of the dense product."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    dense = (rng.random((300, 80)) < 0.15) * rng.random((300, 80))
    dense[:, :6] = rng.random((300, 6))
    dense[7] = 0
    asked = np.concatenate([dense[:12], (rng.random((12, 80)) < 0.2) * rng.random((12, 80)), np.zeros((1, 80))])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    dense, asked = unit(dense), unit(asked)
    rows = lambda m: pa.table({"at": [np.flatnonzero(r).tolist() for r in m], "w": [r[r > 0].tolist() for r in m]},
                              schema=pa.schema([("at", pa.list_(pa.int64())), ("w", pa.list_(pa.float64()))]))
    got = {q: (d.tolist(), s.tolist()) for q, d, s in txt.nearest(rows(dense), rows(asked), 4, 0.05)}
    for q, row in enumerate(asked @ dense.T):
        want = sorted((-round(x, 9), d) for d, x in enumerate(row.tolist()) if round(x, 9) >= 0.05)[:4]
        assert got.get(q, ([], [])) == ([d for _, d in want], [-x for x, _ in want])


def test_similar_plans_no_cross_join(spark):
    from tickframe.catalog import QUERIES

    plan = QUERIES["similarity_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_classifier_learns_and_falls_back(spark, tmp_path):
    words = {"Network": "vpn wifi router", "Hardware": "laptop screen dock"}
    rows = [(f"T{i}", c, f"{w} ticket {i % 7}") for i in range(120) for c, w in [list(words.items())[i % 2]]]
    df = spark.createDataFrame(rows, "number string, category string, text string")
    m = cls.train(df, "category")
    assert m.accuracy > 0.95 and m.classes == ["Hardware", "Network"]
    asked = spark.createDataFrame([("q1", "wifi is down"), ("q2", "new screen"), ("q3", "???")], "number string, text string")
    got = {r["number"]: r["category"] for r in cls.predict_category(m, asked).collect()}
    assert got["q1"] == "Network" and got["q2"] == "Hardware" and len(got) == 3
    assert cls.train(df.limit(20), "category") is None
    cls.save_model(m, str(tmp_path / "m"))
    again = cls.load_model(spark, str(tmp_path / "m"))
    assert (again.classes, again.terms, again.rows, again.accuracy) == (m.classes, m.terms, m.rows, m.accuracy)
    assert cls.predict_category(again, asked).orderBy("number").collect() == cls.predict_category(m, asked).orderBy("number").collect()
    plan = cls.predict_category(m, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # a ticket is scored where it lies
    none = cls.predict_category(None, asked).first()
    assert (none["category"], none["confidence"]) == ("General", 0.5)
    hinted = asked.withColumn("hint", F.when(F.col("number") == "q1", 2))
    p = {r["number"]: (r["priority"], r["confidence"]) for r in cls.predict_priority(None, hinted, "hint").collect()}
    assert p["q1"] == (2, 1.0) and p["q2"] == (3, 0.5)


def test_nested_forms_match_long_forms(incidents):
    tree = tr.root_cause_tree(incidents).collect()
    assert sum(r["total"] for r in tree) == incidents.count()
    assert all(r["total"] == sum(c["count"] for c in r["children"]) for r in tree)
    nested = {r["agent"]: {c["priority"]: c["total"] for c in r["by_priority"]} for r in sco.by_agent_nested(incidents).collect()}
    long = {}
    for r in sco.by_agent_priority(incidents).collect():
        long.setdefault(r["agent"], {})[r["priority"]] = r["total"]
    assert nested == long


def test_wide_form_has_the_named_columns(incidents):
    counts = tr.category(incidents)
    names = [r[0] for r in counts.select("category").distinct().collect()]
    wide = shape.long_to_wide(counts, "period", "category", "count", names)
    assert set(wide.columns) == {"period", "Application Access", "General", "Hardware", "Network", "Software & Tools"}
    assert len(shape.long_to_wide(counts, "period", "category", "count", names[:2]).columns) == 3


def test_keyset_page_continues_offset_page(incidents):
    first = mon.incidents_page(incidents, 1, 20).collect()
    second = [r["number"] for r in mon.incidents_page(incidents, 2, 20).collect()]
    after = mon.incidents_after(incidents, str(first[-1]["created"]), first[-1]["number"], 20)
    assert [r["number"] for r in after.collect()] == second


def test_context_is_cut(spark, incidents):
    q = spark.createDataFrame([(1, "which team has the worst sla and mttr and trend"), (2, "hello")], "id int, text string")
    got = {r["id"]: r for r in ctx.route(q, ctx.facts(incidents)).collect()}
    assert got[1]["context"].endswith("…[context truncated]")
    assert got[2]["sections"] == [] and got[2]["context"].startswith("**Platform Overview**")


def test_scalar_operators_use_no_python(spark):
    """Apart from the vectors of the classifiers no plan holds a Python node."""
    from tickframe.catalog import QUERIES

    skip = ("train_", "predict_", "model_", "stream_", "src_", "sink_", "audit_file", "canonical_audit", "doc_priority")
    for name, q in QUERIES.items():
        if not name.startswith(skip):
            plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "CartesianProduct" not in plan, name


def test_priority_mismatch_judges_every_ticket(spark, incidents):
    from tickframe import catalog

    few = incidents.limit(400).cache()
    text = catalog.with_text(few)
    got = cls.cross_predict_priority(text, text, folds=2)
    assert sorted(r[0] for r in got.select("number").collect()) == sorted(r[0] for r in few.select("number").collect())
    # Also tickets that the other classifiers learn from are reported.
    listed = cls.priority_mismatch(got, few, min_confidence=0.0)
    assert listed.where(~cls.held_out()).count() > 0


def test_numbers_and_quantiles_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "b", "b", None]), rng.choice([None, 1.0, 1.0, 2.5, float(rng.randrange(-50, 50)), rng.random()]), i)
            for i in range(3000)] + [("one", 4.0, 9000), ("none", None, 9001)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(7)
    got = {r["i"]: r["rank"] for r in ordered.numbered(df, [F.desc_nulls_last("v"), F.asc("i")]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    assert got == {r[2]: n for n, r in enumerate(want, 1)}
    got = {r["i"]: r["rank"] for r in ordered.numbered(df, [F.asc("v"), F.asc("i")], within="g").collect()}
    for g in ("a", "b", None, "one", "none"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    found = ordered.quantiles(df, ["g"], "v", {"low": 0.0, "mid": 0.5, "most": 0.95, "top": 1.0}).collect()
    assert {r["g"] for r in found} == {"a", "b", None, "one"}
    for r in found:
        own = sorted(x[1] for x in rows if x[0] == r["g"] and x[1] is not None)
        assert r["n"] == len(own)
        for name, p in (("low", 0.0), ("mid", 0.5), ("most", 0.95), ("top", 1.0)):
            at = p * (len(own) - 1)
            low = int(at)
            value = own[low] * (1 - (at - low)) + (own[low + 1] * (at - low) if at > low else 0)
            assert abs(r[name] - value) < 1e-9
    assert ordered.numbered(df.limit(0), [F.asc("v")]).count() == ordered.quantiles(df.limit(0), ["g"], "v", {"p": 0.5}).count() == 0


def test_no_task_sees_all_groups(spark, incidents):
    """Quantiles and ranks sort by ranges; no exchange brings all rows into one task."""
    for df in (doc.mttr_quantiles(incidents), ordered.numbered(incidents.select("number"), [F.asc("number")])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in plan
        assert plan.count("SinglePartition") <= 1  # the sum over tasks, one row for each


def noisy_tickets(spark, n=4000):
    """Two words tell the class, as often as said by their number: w3 means b in three cases of ten."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        k = rng.randrange(1, 10)
        rows.append((f"T{i}", f"w{k} w{k} common", "b" if rng.random() < k / 10 else "a", k / 10))
    return spark.createDataFrame(rows, "number string, text string, label string, p double")


def test_probabilities_are_calibrated(spark):
    """Of held-out tickets that are given a probability, about that share is of the class."""
    df = noisy_tickets(spark)
    m = cls.train(df, "label")
    got = cls.score(m, df.where(cls.held_out()), ["number", "label", "p"], k=2).collect()
    said = [({c["class"]: c["p"] for c in r["ranked"]}["b"], r["label"] == "b", r["p"]) for r in got]
    assert all(abs(sum(c["p"] for c in r["ranked"]) - 1) < 1e-9 and r["ranked"][0]["p"] >= r["ranked"][1]["p"] for r in got)
    for low in (0.0, 0.25, 0.5, 0.75):
        own = [(p, is_b) for p, is_b, _ in said if low <= p < low + 0.25]
        if len(own) >= 80:
            assert abs(sum(p for p, _ in own) / len(own) - sum(b for _, b in own) / len(own)) < 0.09
    # The curve has two parameters, the true shares lie on a line: near, not equal.
    assert sum(abs(p - true) for p, _, true in said) / len(said) < 0.08


def test_scores_by_hand(spark, tmp_path):
    """Probabilities computed from the stored vocabulary and coefficients, with plain arithmetic."""
    df = noisy_tickets(spark, 600).withColumn("label", F.when(F.rand(3) < 0.3, "c").otherwise(F.col("label")))
    m = cls.train(df, "label")
    cls.save_model(m, str(tmp_path / "m"))
    idf = {r["term"]: (r["idx"], r["idf"]) for r in spark.read.parquet(str(tmp_path / "m" / "terms")).collect()}
    machines = spark.read.parquet(str(tmp_path / "m" / "machines")).collect()
    texts = ["w1 w1 common", "w9 common common w2", "unseen words only", "", None]
    asked = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "number string, text string")
    for r in cls.score(m, asked, ["number"], k=3).collect():
        words = (texts[int(r["number"])] or "").split()
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        v = {t: (1 + math.log(terms.count(t))) * idf[t][1] for t in set(terms) if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        p = {}
        for fold in range(3):
            own = {x["class"]: 1 / (1 + math.exp(-(x["slope"] * (x["weights"][-1] + sum(
                x["weights"][idf[t][0]] * y / norm for t, y in v.items())) + x["shift"]))) for x in machines if x["fold"] == fold}
            for c, y in own.items():
                p[c] = p.get(c, 0) + y / sum(own.values()) / 3
        assert {c["class"] for c in r["ranked"]} == set(p)
        assert all(abs(c["p"] - p[c["class"]]) < 1e-5 for c in r["ranked"])


def test_machines_reach_the_least_risk(spark, monkeypatch):
    """No small step from the fitted coefficients lowers the risk of squared hinges."""
    rng = random.Random(2)
    rows = [([0, 1 + i % 3], [0.6, 0.8], float(rng.random() < 0.2 + 0.3 * (i % 3)), 1.5, i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "idx array<long>, val array<double>, label double, balance double, fold int").repartition(3)
    monkeypatch.setattr(svm, "ENOUGH", 1e-6)
    m = svm.fit(df, 4, 2, 300, steps=200)
    risk = lambda w: svm._risk(df, w, 4, 2, 3, 300, 3)[0]
    few, grad = svm._risk(df, m.weights, 4, 2, 3, 300, 3)
    many, same = svm._risk(df, m.weights, 4, 2, 3, 300, 10**9)  # added up in tasks
    assert abs(few - many) < 1e-12 and np.allclose(grad, same, atol=1e-12)
    least = risk(m.weights)
    for _ in range(6):
        assert risk(m.weights + 0.02 * np.random.default_rng(_).normal(size=m.weights.shape)) > least - 1e-6
    by_hand = 0.5 / 300 * float((m.weights**2).sum())
    for idx, val, label, balance, fold in rows:
        for f in range(3):
            for c in range(2):
                y = 1 if c == label else -1
                z = m.weights[-1, f * 2 + c] + sum(v * m.weights[i, f * 2 + c] for i, v in zip(idx, val))
                by_hand += (f != fold) * (balance if y > 0 else 1) * max(0, 1 - y * z) ** 2 / 300
    assert abs(by_hand - least) < 1e-4


def test_training_reads_its_tickets_once_by_all_cores(spark):
    """A plan behind the tickets runs once, and a small file is not left to one task for every step of the fit."""
    from pyspark.sql.functions import udf

    seen = spark.sparkContext.accumulator(0)

    def said(text):
        seen.add(1)
        return text

    df = noisy_tickets(spark, 300).coalesce(1).withColumn("text", udf(said, "string")("text"))
    assert cls.train(df, "label").accuracy > 0.5
    assert seen.value == 300
    asked = noisy_tickets(spark, 300).coalesce(1).withColumn("priority", F.when(F.col("label") == "a", 1).otherwise(2))
    once = asked.withColumn("text", udf(said, "string")("text"))
    cls.cross_predict_priority(once, asked, folds=3)
    assert seen.value == 600
    from tickframe.session import dealt

    kept = dealt(asked, "few")
    assert kept.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and kept.count() == 300


def test_a_start_from_some_tickets_changes_passes_only(spark, monkeypatch):
    """All tickets decide where the fit ends: the same machines, by fewer passes over all of them."""
    df, sizes, risk = noisy_tickets(spark), [], svm._risk

    def counted(rows, w, n_terms, classes, folds, n, tasks):
        sizes.append(n)
        return risk(rows, w, n_terms, classes, folds, n, tasks)

    monkeypatch.setattr(svm, "_risk", counted)
    monkeypatch.setattr(svm, "ENOUGH", 1e-4)
    plain = cls.train(df, "label")
    passes, n = len(sizes), sizes[0]
    sizes.clear()
    monkeypatch.setattr(cls, "EARLY", 1000)
    begun = cls.train(df, "label")
    assert 700 < min(sizes) < 1300 and sizes.count(n) < passes
    assert plain.terms == begun.terms
    assert abs(plain.machines.weights - begun.machines.weights).max() < 0.02


def test_text_features_split_texts_once(spark):
    texts = spark.createDataFrame([(1, "Disk full disk"), (2, "disk FULL again"), (2, "full"), (3, None), (None, "again, again")], "id long, text string")
    found = txt.text_features(texts, "id", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "Join" not in plan
    got = {(r["id"], r["term"]): r["weight"] for r in found.collect()}
    tf, df = {("disk", 1): 2, ("again", None): 2}, {"disk": 2, "full": 3, "again": 2, "disk full": 2}
    terms = {1: ["disk", "full", "disk full"], 2: ["disk", "full", "again", "disk full", "full"], None: ["again"]}
    want = {}
    for i, ts in terms.items():
        v = [(x, (1 + math.log(tf.get((x, i), 1))) * (math.log(6 / (1 + df[x])) + 1)) for x in ts]
        norm = math.sqrt(sum(w * w for _, w in v))
        want.update({(i, x): w / norm for x, w in v})
    assert got == pytest.approx(want)
    limited = txt.text_features(texts, "id", "text", max_terms=1).collect()
    assert sorted((str(r["id"]), r["term"], r["weight"]) for r in limited) == [("2", "again", 1.0), ("None", "again", 1.0)]


def test_text_features_shuffle_no_row_of_a_text_and_a_term(spark, monkeypatch):
    """Terms meet by blocks, here of a few texts: what is shuffled lies below the step that makes rows of terms, and weights are whole."""
    import re
    from collections import Counter

    from tickframe.operators import term_blocks

    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["élan", "Straße", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    monkeypatch.setattr(term_blocks, "BLOCK", 500)
    monkeypatch.setattr(term_blocks, "ENTRIES", 100)
    unique = txt.text_features(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    plan = unique._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and "Window" not in plan
    rows_again = rows + [(7, "w1 w2 w1"), (7, "w1 w2 w1"), (None, "w3 w4"), (None, rows[3][1])]
    again = txt.text_features(spark.createDataFrame(rows_again, "id long, text string"), "id", "text")
    for given, found in ((rows, unique), (rows_again, again)):
        texts = []
        for i, t in given:
            w = [x for x in re.findall(r"\w{2,}", t.lower().replace("é", "e"))]
            texts.append((i, Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])))
        df = Counter(t for _, c in texts for t in c)
        v = [(i, t, (1 + math.log(n)) * (math.log((1 + len(given)) / (1 + df[t])) + 1)) for i, c in texts for t, n in c.items() if df[t] > 1]
        norm = Counter()
        for i, _, x in v:
            norm[i] += x * x
        want = sorted((str(i), t, round(x / math.sqrt(norm[i]), 9)) for i, t, x in v)
        assert sorted((str(r["id"]), r["term"], round(r["weight"], 9)) for r in found.collect()) == want


def test_nearest_meets_few_of_the_weights(monkeypatch):
    """Texts of all lengths over terms of all frequencies, in many small parts: the best of the dense product, from a part of the postings."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    often = 1 / np.arange(1, 401)
    dense = (rng.random((600, 400)) < np.minimum(often * np.geomspace(0.5, 40, 600)[:, None], 0.95)) * np.log(2 / often)
    asked = (rng.random((40, 400)) < np.minimum(8 * often, 0.9)) * np.log(2 / often)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    dense, asked = unit(dense[rng.permutation(600)]), unit(asked)
    rows = lambda m: pa.table({"at": [np.flatnonzero(r).tolist() for r in m], "w": [r[r > 0].tolist() for r in m]},
                              schema=pa.schema([("at", pa.list_(pa.int64())), ("w", pa.list_(pa.float64()))]))
    met, ranges, scored, inside = [0], txt._ranges, txt._Part.scored, [False]

    def counted(begins, sizes):
        met[0] += int(sizes.sum()) if inside[0] else 0
        return ranges(begins, sizes)

    def within(*args):
        inside[0] = True
        try:
            return scored(*args)
        finally:
            inside[0] = False

    for name, value in (("TOGETHER", 50), ("PAIRS", 500), ("ENTRIES", 300), ("_ranges", counted)):
        monkeypatch.setattr(txt, name, value)
    monkeypatch.setattr(txt._Part, "scored", within)
    for k, share in ((1, 0.65), (4, 0.8)):
        met[0] = 0
        got = {q: (d.tolist(), s.tolist()) for q, d, s in txt.nearest(rows(dense), rows(asked), k, 0.05)}
        assert met[0] < share * ((asked > 0).astype(int) @ (dense > 0).T.astype(int)).sum()
        for q, row in enumerate(asked @ dense.T):
            want = sorted((-round(x, 9), d) for d, x in enumerate(row.tolist()) if round(x, 9) >= 0.05)[:k]
            assert got.get(q, ([], [])) == ([d for _, d in want], [-x for x, _ in want])


def test_similar_deals_texts_by_their_largest_weight(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [0] * (i % 7 + 1), [0.9 ** (i % 40)] * (i % 7 + 1)) for i in range(400)], "_c long, at array<long>, w array<double>")
    monkeypatch.setattr(txt, "CELL", 100)
    dealt, cells = txt._dealt_by_size(docs, 4)
    rows = [(r["_cb"], r["w"][0], len(r["w"])) for r in dealt.collect()]
    assert len(rows) == 400 and {c for c, _, _ in rows} <= set(range(cells)) and cells <= 400 * 4 / 100 + 61
    assert all(max(w for c, w, _ in rows if c == cell) <= 2 * min(w for c, w, _ in rows if c == cell) for cell in {c for c, _, _ in rows})
    assert max(sum(n for c, _, n in rows if c == cell) for cell in range(cells)) <= 400


def test_similar_measures_all_rows_of_a_key(spark):
    """A row without any word that is asked for makes its key's text longer all the same."""
    c = spark.createDataFrame([(1, "red ring"), (1, "blue bolt"), (2, "red ring"), (3, "old gear")], "d int, text string")
    q = spark.createDataFrame([(1, "red ring"), (2, "no such")], "q int, text string")
    got = {(r["q"], r["d"]): r["score"] for r in txt.similar(q, c, "q", "d", k=5).collect()}
    red, blue = 3 * (math.log(5 / 3) + 1) ** 2, 3 * (math.log(5 / 2) + 1) ** 2
    assert got == {(1, 1): pytest.approx(red / math.sqrt(red * (red + blue)), abs=1e-8), (1, 2): 1.0}


def test_nearest_adds_up_a_term_that_a_row_has_twice():
    """Rows of one key make one text, whose terms then come twice, in the queries too; common terms are skipped at first."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    kind = pa.schema([("at", pa.list_(pa.int64())), ("w", pa.list_(pa.float64()))])
    one = lambda: np.flatnonzero(rng.random(40) < np.linspace(0.9, 0.02, 40)).tolist()
    texts, asked = ([a + (a if i % 3 else one()) for i, a in enumerate(one() for _ in range(n))] for n in (200, 30))
    docs, queries = (pa.table({"at": x, "w": [(rng.random(len(a)) * 0.3).tolist() for a in x]}, schema=kind) for x in (texts, asked))
    dense = lambda t: np.array([np.bincount(a, w, 40) for a, w in zip(t["at"].to_pylist(), t["w"].to_pylist())])
    got = {q: (d.tolist(), s.tolist()) for q, d, s in txt.nearest(docs, queries, 3, 0.05)}
    for q, row in enumerate(dense(queries) @ dense(docs).T):
        want = sorted((-round(x, 9), d) for d, x in enumerate(row.tolist()) if round(x, 9) >= 0.05)[:3]
        assert got.get(q, ([], [])) == ([d for _, d in want], [-x for x, _ in want])
