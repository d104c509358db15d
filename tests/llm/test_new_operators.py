import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import messy_rows, table
from tests.llm.test_contracts import runs_by_hand
from tickframe.llm import conversations, periodic, secret_scan
from tickframe.llm.labelled_findings import findings


# ---- periodic runs ----

@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6), st.integers(0, 2))
def test_runs_equal_brute_force(parts, cut):
    w = [x for block, times in parts for x in block * times][: 140]
    w = w[cut:]
    assert periodic.runs_of(w) == runs_by_hand(w)


def test_runs_of_long_texts():
    assert periodic.runs_of(["x"] * 300_000) == [(0, 300_000, 1)]
    assert periodic.runs_of([str(i % 7000) for i in range(50_000)]) == [(0, 50_000, 7000)]
    rng = random.Random(1)
    assert periodic.runs_of([rng.random() for _ in range(100_000)]) == []
    block = [f"l{i}" for i in range(10)]
    w = (block * 2 + [f"m{i}" for i in range(10)]) * 100
    assert periodic.runs_of(w)[:2] == [(0, 20, 10), (0, 3000, 30)]


def test_collapsed_texts(spark):
    rows = [(1, "a b c " * 5 + "end"), (2, None), (2, None), (None, "one two"), (3, "A\tb\x0bA  b " * 6), (4, "ü " * 12), (5, "ü " * 11)]
    got = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])
                  for r in periodic.periodic_runs(table(spark, rows)).collect()))
    assert got == [(0, 2, [], "one two"), (1, 16, [(0, 15, 3)], "a b c end"), (2, 0, [], ""), (2, 0, [], ""),
                   (3, 24, [(0, 24, 2)], "A b"), (4, 12, [(0, 12, 1)], "ü"), (5, 11, [], " ".join("ü" * 11))]
    assert periodic.periodic_runs(table(spark, messy_rows())).count() == len(messy_rows())


# ---- conversation repair ----

def test_the_table_reads_the_grammar():
    """The LR table accepts exactly the sentences (s?(ua)+)?."""
    import itertools
    import re

    shift, _, accept = conversations._moves()
    for n in range(8):
        for roles in itertools.product("sua", repeat=n):
            top = 0
            for r in roles:
                top = shift.get((top, r)) if top is not None else None
            assert (top in accept) == bool(re.fullmatch("(s?(ua)+)?", "".join(roles)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suaut "), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])), max_size=30),
       st.lists(st.integers(0, 30), max_size=4))
def test_blocks_put_together_equal_the_whole(rows, cuts):
    cuts = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
    parts = [conversations.block_ways(tuple(rows[a:b])) for a, b in zip(cuts, cuts[1:])]
    cost, path = conversations.best_repair(parts)
    whole_cost, whole = conversations.best_repair([conversations.block_ways(tuple(rows))])
    assert cost == whole_cost and "".join(x for _, x in path) == "".join(x for _, x in whole)


def test_a_long_conversation_is_split(spark):
    """One conversation holds most rows: it lies in many blocks, none larger than its bound."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"text {i}.") for i in range(9000)] + [(8, 0, "user", "q."), (8, 1, "assistant", "a.")]
    repair = conversations.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sizes = repair.faults.groupBy("talk", conversations._block_of(repair.faults["seq"])).count().collect()
    assert max(r["count"] for r in sizes) <= 1 << conversations.BLOCK_BITS and len(sizes) >= 4
    got = {r["conv_id"]: (r["cost"], set(r["audit"]), len(r["audit"])) for r in repair.report().collect()}
    assert got == {7: (0, {"K"}, 9000), 8: (0, {"K"}, 2)}
    assert repair.rows().count() == 9002


def test_inserted_and_rerolled_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "tool", "b."), (2, 0, "system", "only."), (3, None, None, None)]
    repair = conversations.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.report().collect()}
    assert got == {1: (2, "KRR"), 2: (2, "D"), 3: (2, "D")}
    assert [(r["conv_id"], r["turn"], r["role"]) for r in repair.rows().orderBy("position").collect()] == [
        (1, 0, "system"), (1, 1, "user"), (1, 2, "assistant")]


# ---- secrets ----

@pytest.fixture(scope="module")
def model():
    return secret_scan.fit()


def test_held_out_findings(model):
    rows = findings(3000, seed=77)
    spans, y = [(b + v + a, len(b), len(b) + len(v)) for b, v, a, _ in rows], np.array([r[3] for r in rows])
    p = model.probabilities(spans)
    hit = p >= np.array([model.thresholds[secret_scan.shape_of(r[1])] for r in rows])
    assert hit[y == 1].mean() > 0.97 and hit[y == 0].mean() < 0.01
    # Calibrated: of what is given a probability about that share are secrets.
    assert abs(p.mean() - y.mean()) < 0.02 and y[p < 0.1].mean() < 0.02 and y[p > 0.9].mean() > 0.98


def test_the_network_by_hand(model):
    """One candidate through plain loops."""
    text, start, end = "my key is 'aB3dE5gH7jK9mN1p' yes", 11, 27
    regions = [text[max(0, start - 24): start], text[start:end], text[end: end + 8]]
    sign = lambda c: 96 if c.isspace() else ord(c) - 31 if ord(c) < 127 else 98
    ids = [x for r, part in enumerate(regions) for x in [r * secret_scan.SIGNS, *(sign(c) + r * secret_scan.SIGNS for c in part)]]
    of = [r for r, part in enumerate(regions) for _ in range(len(part) + 1)]
    padded = [0, 0, *ids, 0, 0]
    h = [[max(0.0, float(model.offset[f]) + sum(float(model.tables[k, padded[i + k], f]) for k in range(5))) for f in range(secret_scan.FILTERS)]
         for i in range(len(ids))]
    pooled = [max(h[i][f] for i in range(len(ids)) if of[i] == r) for r in range(3) for f in range(secret_scan.FILTERS)]
    pooled += [sum(h[i][f] for i in range(len(ids)) if of[i] == 1) / of.count(1) for f in range(secret_scan.FILTERS)]
    z = sum(float(w) * x for w, x in zip(model.weights, pooled)) + model.bias
    assert abs(model.logits([(text, start, end)])[0] - z) < 1e-3


def test_gradients(model):
    """Analytic gradients against differences."""
    rows = findings(40, seed=5)
    c, y = secret_scan._cells([(b + v + a, len(b), len(b) + len(v)) for b, v, a, _ in rows]), np.array([r[3] for r in rows], float)
    m = secret_scan.SecretModel(model.tables.astype(np.float64), model.offset.astype(np.float64), model.weights / 20, model.bias / 20)

    def loss():
        z = m.pooled(c, m.hidden(c)) @ m.weights + m.bias
        return float((np.logaddexp(0, z) - y * z).mean())

    grads = secret_scan._step(m, c, y)
    rng = np.random.default_rng(2)
    for array, grad in zip((m.tables, m.offset, m.weights), grads):
        strong = np.argsort(-np.abs(grad).ravel())[:40]
        for i in rng.choice(strong, 5, replace=False):
            flat = array.reshape(-1)
            old, eps = flat[i], 1e-5
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - grad.ravel()[i]) < 1e-4 + 0.02 * abs(grad.ravel()[i])


def test_thresholds_keep_the_recall():
    rng = np.random.default_rng(8)
    y = (rng.random(500) < 0.4).astype(float)
    p = np.clip(0.3 * rng.random(500) + 0.5 * y, 0, 1)
    at = secret_scan._threshold(p, y, 0.95)
    assert (p[y == 1] >= at).mean() >= 0.95 and (p[y == 0] >= at).sum() == 0
    assert secret_scan._threshold(p, np.zeros(500), 0.95) == float("inf")


def test_more_than_the_patterns(spark, model):
    key = "ghp_A1b2C3d4E5f6G7h8I9j0KlMnOpQrStUv"
    texts = [f"Authorization: Bearer {key} and so on", "write to ment.34@mail7.example.com or call 6625883203433323", "x" * 50000, "a1" * 40000,
             f"token={key}", None, "", "PASSWORD = hunter2hunter2 passwd:ab"]
    found = model.scan(texts)
    assert [f[:3] for f in found[0]] == [("found", 22, 22 + len(key))] and found[1] == [] and found[2] == []
    assert [f[0] for f in found[4]] == ["assign"] and found[5] == found[6] == [] and [f[:3] for f in found[7]] == [("assign", 0, 25)]
    got = secret_scan.scan_documents(table(spark, [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] + messy_rows()), model)
    assert got.count() == len(texts) + 1 + len(messy_rows())
