import hashlib
import random
import subprocess
import sys
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.data import gather, messy_rows, table, words
from tests.llm.test_dedup import big, groups_by_hand, low, print_by_hand
from tests.llm.test_text import contamination_by_hand
from tests.llm.test_tokens import crc, library_ids
from tickframe.llm import language
from tickframe.llm.common import crc_of_id
from pyspark.sql import functions as F


def write(spark, folder, rows, items):
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_by_hand(spark, tmp_path):
    rng = random.Random(8)
    items = [(i, words(rng, 14, 60)) for i in range(5)]
    rows = [(d, t, "en") for d, t in messy_rows(8)] + [(5000 + i, words(rng, 30) + " " + t, "en") for i, t in items]
    rows += [(6000 + i, words(rng, 60), "en" if i % 3 else None) for i in range(40)]
    write(spark, tmp_path, rows, items)
    got = gather(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"))

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.fit(docs.filter(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2))
    kept = [(d, t) for d, t, _ in rows if model.predict(t)[2]]
    texts = defaultdict(list)
    for d, t in kept:
        texts[low(t)].append((d, t))
    kept = [max(v, key=lambda r: big(r[0])) for v in texts.values()]
    prints = {t: print_by_hand(t, 4) for _, t in kept}
    root = groups_by_hand(prints.values(), 4)
    groups = defaultdict(list)
    for d, t in kept:
        groups[root[prints[t]]].append((d is None, d or 0, hashlib.sha256(t.encode()).hexdigest(), d, t))
    stay = [min(g)[3:] for g in groups.values()]
    assert sum(d is None for d, _ in stay) + sum(d == 2003 for d, _ in stay) > 0
    bad = {r for r in stay if any(k[5] for k in contamination_by_hand([r], items))}
    assert {d for d, _ in bad} & {5000, 5001, 5002, 5003, 5004}
    want = Counter()
    for d, t in stay:
        if (d, t) not in bad:
            ids = library_ids(t)
            want.update((d, s, len(ids[s:s + 4096]), crc(ids[s:s + 4096]), len(ids)) for s in range(0, len(ids), 4096))
    assert Counter(got) == want


def test_stages_keep_the_columns(spark, tmp_path):
    write(spark, tmp_path, [(i, f"some words that make text number {i} of a few", "en") for i in range(30)], [(1, "x y z")])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and 0 < out.count() <= 30


def test_empty_corpus(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert gather(corpus_pipeline.run(spark, str(tmp_path))) == []


def test_entry_lists_the_queries_and_the_rest_stands_alone():
    code = ("import sys\nfor m in ('corpus_pipeline', 'tickframe.llm'): sys.modules[m] = None\n"
            "import __spark_entry__ as e\nq = e.queries()\nassert q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q")
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 14)} <= {k.split("_")[0] for k in e.queries()} and "pipeline" in e.queries()
    subprocess.run([sys.executable, "-c", code], check=True, cwd=e.__file__.rsplit("/", 1)[0])
