import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import gather, messy_rows, table, words
from tickframe.llm import exact_dedup, line_dedup, simhash
from tickframe.llm.common import stored
from tickframe.llm.components import components

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def low(text):
    return (text or "").translate(AZ)


def big(doc_id):
    return -1 if doc_id is None else doc_id


# ---- exact dedup ----

def exact_by_hand(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    return Counter((d, max(groups[low(t)], key=big), len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest())
                   for d, t in rows)


@pytest.mark.parametrize("sizes", [(1024, 8192), (4, 9)])
def test_exact_groups(spark, sizes):
    rows = messy_rows()
    got = gather(exact_dedup.exact_groups(table(spark, rows), least=sizes[0], most=sizes[1]))
    assert Counter((d, k, n, h) for d, k, n, _, h in got) == exact_by_hand(rows)
    kept = [(d, h) for d, k, _, stays, h in got if stays]
    assert len(kept) == len({h for _, h in kept}) == len({low(t) for _, t in rows})
    assert all(d == k for d, k, _, stays, _ in got if stays)


@pytest.mark.parametrize("few", [exact_dedup.FEW_CLASHES, 0])
def test_shared_identifiers_are_told_apart(spark, monkeypatch, few):
    monkeypatch.setattr(exact_dedup, "FEW_CLASHES", few)
    monkeypatch.setattr(exact_dedup, "identifier", lambda chunk: F.length(chunk).cast("long"))
    rows = [(1, "aaaa"), (2, "bbbb"), (3, "aaaa"), (4, "cc"), (5, None), (6, "aaaa bbbb."), (7, "bbbb aaaa."), (7, "bbbb aaaa.")]
    got = gather(exact_dedup.exact_groups(table(spark, rows)))
    assert Counter((d, k, n, h) for d, k, n, _, h in got) == exact_by_hand(rows)


def test_chunks_give_the_text_back(spark):
    rows = messy_rows()
    for d in exact_dedup.chunked(table(spark, rows), "doc_id", "text", 16, 64).collect():
        assert "".join(d["chunks"]) == d["norm"] and all(0 < len(c) <= 64 for c in d["chunks"])


def test_exact_empty(spark):
    assert gather(exact_dedup.exact_groups(table(spark, []))) == []


# ---- line dedup ----

def lines_by_hand(rows, least, common):
    key = lambda x: x.strip(BLANK).translate(AZ)
    count, last = Counter(), {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] += 1
            last[k] = max(last.get(k), d, key=big) if k in last else d
    out = Counter()
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and count[key(x)] >= common and last[key(x)] != d)]
        out[d, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def line_rows():
    rng = random.Random(5)
    lines = [words(rng, rng.randrange(1, 12)) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice(["", "  ", "\t", "X"]) + rng.choice(lines).upper()[: rng.randrange(10, 60)] if rng.random() < .3
                          else rng.choice(lines) + rng.choice(["", " \r", "\x0b"]) for _ in range(rng.randrange(1, 25)))) for i in range(80)]
    return rows + messy_rows() + [(9000, "\n\n\n"), (9001, lines[0] + "\n" + lines[0]), (9001, lines[0]), (None, lines[0])]


@pytest.mark.parametrize("batches,fan_out", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fan_out):
    rows = line_rows()
    got = line_dedup.dedup_lines(table(spark, rows), least=20, common=4, batches=batches, fan_out=fan_out)
    got = got.select("doc_id", "n_lines_", "n_dropped", "kept_text_")
    assert Counter(gather(got)) == lines_by_hand(rows, 20, 4)


def test_line_runs_tell_fresh_keys(spark):
    a, b = (line_dedup.line_keys(table(spark, r), least=1) for r in ([(1, "p\nq\np"), (2, "q")], [(3, "q\nr")]))
    runs = line_dedup.LineRuns(spark, fan_out=4, buckets=3)
    runs.add(a)
    new = b.filter("first").groupBy("h1", "h2").count()
    assert runs.fresh(new).count() == 1
    runs.add(b)
    assert sorted((r["n_docs"], r["last_doc"]) for r in runs.keys().collect()) == [(1, 1), (1, 3), (3, 3)]
    # A key lies in one run only; a later batch brings the counts of known ones beside its own.
    assert [(k.count(), u.count() if u is not None else 0) for k, u in runs.runs] == [(2, 0), (1, 1)]
    runs.forget()


def test_line_dedup_empty(spark):
    assert gather(line_dedup.dedup_lines(table(spark, []))) == []


# ---- SimHash ----

def print_by_hand(text, shingle):
    import re

    from xxhash import xxh64_intdigest

    w = re.findall(rb"[^\x20\x09-\x0D]+", low(text).encode())
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i:i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(prints, bits):
    """Component (smallest id) of each row, by comparing all fingerprints."""
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


@pytest.mark.parametrize("per_task", [2_000_000, 3000])
def test_near_groups(spark, per_task):
    rows = messy_rows(3)
    got = Counter(gather(simhash.near_groups(table(spark, rows), per_task=per_task)))
    prints = [print_by_hand(t, 4) for _, t in rows]
    root = groups_by_hand(prints, 4)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    assert got == Counter((d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(rows, prints))


@pytest.mark.parametrize("bits,per_task", [(2, 500), (4, 2_000_000), (4, 20_000), (4, 3000), (6, 200_000)])
def test_links_connect_what_is_near(spark, bits, per_task):
    rng = np.random.default_rng(bits)
    centres = rng.integers(0, 2**64, 4, dtype=np.uint64)
    crowd = [int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centres for _ in range(60)]
    values = sorted({*crowd, 0, 1, 2**64 - 1, 2**63, *map(int, rng.integers(0, 2**64, 40, dtype=np.uint64))})
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = gather(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bits, per_task))
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= bits for u, v in found)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in found:
        a, b = find(u & (2**64 - 1)), find(v & (2**64 - 1))
        parent[max(a, b)] = min(a, b)
    assert {v: find(v) for v in values} == groups_by_hand(values, bits)


def test_one_of_each_group(spark):
    rows = messy_rows(3)
    docs = table(spark, rows)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    groups = gather(simhash.near_groups(docs))
    named = {(c,) for _, _, c in groups}
    assert Counter(gather(kept.select("doc_id"))) == Counter(named)


def test_one_of_each_group_where_ids_are_null_or_shared(spark):
    rng = random.Random(11)
    texts = [words(rng, 60) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(None, texts[0]), (None, texts[1].upper()), (7, texts[5]), (7, texts[6]), (7, texts[6]),
            (7, texts[7]), (3, texts[7].upper()), (None, texts[8]), (9, texts[8].upper()), (9, texts[9]), (4, None), (4, "")]
    root = groups_by_hand([print_by_hand(t, 4) for _, t in rows], 4)
    best = {}
    for d, t in rows:
        sha = "null" if t is None else hashlib.sha256(t.encode()).hexdigest()
        rank = (d is None, d or 0, sha)
        g = root[print_by_hand(t, 4)]
        best[g] = min(best.get(g, (rank, d, t)), (rank, d, t))
    assert len(best) == 11
    got = gather(simhash.one_of_each_group(table(spark, rows)).select("doc_id", "text"))
    assert Counter(got) == Counter((d, t) for _, d, t in best.values())


def test_near_groups_empty_and_single(spark):
    assert gather(simhash.near_groups(table(spark, []))) == []
    assert gather(simhash.near_groups(table(spark, [(7, None)]))) == [(7, "0" * 16, 7)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (201, 201), (300, 300)]
    got = dict(gather(components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


def test_few_edges_are_written_in_few_files(spark, monkeypatch):
    written = defaultdict(list)

    def noted(df, purpose):
        out = stored(df, purpose)
        written[purpose].append(len(out.inputFiles()))
        return out

    monkeypatch.setattr("tickframe.llm.components.stored", noted)
    monkeypatch.setattr(simhash, "stored", noted)
    asked = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        got = dict(gather(components(spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long"), 300)))
        assert got == dict.fromkeys(range(301), 0)
        rows = [(i, f"text number {i} of {i * i}") for i in range(200)]
        assert simhash.near_groups(table(spark, rows)).count() == 200
        for kept in (exact_dedup.distinct_documents, simhash.one_of_each_group):
            noted(kept(table(spark, rows)), "kept")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    for purpose in ("large_star", "small_star", "nodes", "edges", "kept"):
        assert 0 < max(written[purpose]) <= cores, written
