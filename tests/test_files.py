"""Sources, sinks, upload audits and streams on small files."""

import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickframe.operators import quality as qua
from tickframe.sources import files, keys, sinks
from tickframe.streaming import jobs


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


HEAD = "Number,Opened At,Assignment group,Priority,State,Short description,Service offering,Made SLA,Extra\n"


@pytest.fixture
def uploads(tmp_path):
    a = write(tmp_path / "a.csv", HEAD + 'INC1,01-02-2026 10:00,G1,P1,new,"login, ""sso""\nfails",Portal,YES,x\n'
              'INC2,2026-02-03 11:00:00,G1,2 - High,wip,vpn wifi error,,no,x\nINC1,01-02-2026 12:00,G2,P1,Closed,later,,TRUE,x\n')
    b = write(tmp_path / "b.csv", HEAD + 'INC1,01-02-2026 13:00,G3,P4,Closed,newest,,TRUE,x\n ,,,,,,,,\nINC9,junk,G1,,,,,,\n')
    return [a, b]


def test_clean_incidents_from_csv(spark, uploads):
    org = spark.createDataFrame([("G1", "T1", "S1")], "assignment_group string, tower string, sdm string")
    rows = files.read_incidents_csv(spark, uploads[0], org).orderBy("created").collect()
    r = rows[0]
    assert (r["number"], r["priority"], r["state"], r["made_sla_bool"]) == ("INC1", 1, "Open", True)
    assert r["created"] == datetime(2026, 2, 1, 10) and r["short_description"] == 'login, "sso"\nfails'
    assert (r["category"], r["subcategory"], r["tower"], r["sdm"]) == ("Application Access", "Login/SSO", "T1", "S1")
    assert r["first_assignment_group"] == "G1" and r["month"] == "2026-02" and r["week"] == "2026-01-26/2026-02-01"
    assert rows[2]["category"] == "Network" and rows[1]["tower"] == ""


def test_last_row_of_last_file_wins(spark, uploads):
    from tickframe.operators.ingest import dedup_keep_last, drop_blank_key

    rows = files.read_many(spark, uploads)
    last = {r["number"]: r["short_description"] for r in dedup_keep_last(drop_blank_key(rows)).collect()}
    assert last["INC1"] == "newest" and set(last) == {"INC1", "INC2", "INC9"}
    one = files.read_many(spark, uploads[:1])
    assert {r["number"]: r["short_description"] for r in dedup_keep_last(one).collect()}["INC1"] == "later"


def test_upload_audits(spark, uploads):
    rows = files.read_many(spark, uploads)
    old = spark.createDataFrame([("INC2",)], "number string")
    got = {r["file"]: r for r in qua.file_summary(rows.where(F.trim("number") != ""), old).collect()}
    assert (got["a.csv"]["rows_in_file"], got["a.csv"]["internal_duplicates"], got["a.csv"]["existing_duplicates"],
            got["a.csv"]["net_new_rows"]) == (3, 1, 1, 1)
    blanks = {r["column"]: r["blanks"] for r in qua.required_blank(rows).collect()}
    assert blanks == {"number": 1, "created": 1, "first_assignment_group": 1, "priority": 2, "state": 2}
    audit = {r["file"]: r for r in files.file_column_audit(spark, uploads).collect()}
    assert audit["a.csv"]["columns_dropped"] == ["extra"] and "urgency" in audit["a.csv"]["columns_added"]


def test_columns_are_matched_by_name(spark, tmp_path):
    folder = tmp_path / "orders"
    folder.mkdir()
    write(folder / "a.csv", "Number,State,Priority,Opened At\nINC1,Closed,P1,4-6-2026 9:05\n")
    write(folder / "b.csv", "Opened At,Number,Priority,State\n04/06/2026,INC2,P2,Open\n")
    write(folder / "c.csv", "number,Extra,state,priority\nINC3,x,On Hold,P4\n")
    got = {r["number"]: (r["state"], r["priority"], r["created"]) for r in files.read_incidents_csv(spark, str(folder)).collect()}
    assert got == {"INC1": ("Closed", 1, datetime(2026, 6, 4, 9, 5)), "INC2": ("Open", 2, datetime(2026, 6, 4)),
                   "INC3": ("On Hold", 4, None)}
    assert {r["Number"]: r["Priority"] for r in files.read_csv(spark, str(folder)).where("`Opened At` IS NOT NULL").select(
        "Number", "Priority").collect()} == {"INC1": "P1", "INC2": "P2"}


def test_many_uploads(spark, tmp_path):
    paths = [write(tmp_path / f"u {i}+é.csv", f"Number,State\nINC{i},Open\n") for i in range(12)]
    assert sorted(r["_seq"]["file"] for r in files.read_many(spark, paths).collect()) == list(range(12))


def test_windows_1252_is_told_from_latin1(spark, tmp_path):
    p = write(tmp_path / "w.csv", "Number,Text\nINC1,5 € “so”\n", "cp1252")
    assert files.read_csv(spark, p).first()["Text"] == "5 € “so”"


def test_latin1_is_detected(spark, tmp_path):
    p = write(tmp_path / "l.csv", "Number,Short description\nINC1,café\n", "latin-1")
    q = write(tmp_path / "u.csv", "Number,Short description\nINC1,café\n", "utf-8")
    for path in (p, q):
        assert files.read_csv(spark, path).first()["Short description"] == "café"


def test_mixed_encodings_in_one_folder(spark, tmp_path):
    folder = tmp_path / "mix"
    folder.mkdir()
    write(folder / "a.csv", "Number,Text\nINC1,café\n", "latin-1")
    write(folder / "b.csv", "Number,Text\nINC2,naïve \ufffd\n", "utf-8")
    write(folder / "c.csv", "Number,Text\nINC3,plain\n", "utf-8")
    got = {r["Number"]: r["Text"] for r in files.read_csv(spark, str(folder)).collect()}
    assert got == {"INC1": "café", "INC2": "naïve \ufffd", "INC3": "plain"}


def test_known_files_are_read_once_and_in_parts(spark, tmp_path):
    """With encoding and header given no pass over the lines is made; without line ends in fields files are split."""
    folder = tmp_path / "known"
    folder.mkdir()
    for f in range(2):
        (folder / f"{f}.csv").write_bytes(("Number,State,Short description\n" + "".join(
            f"INC{f}{i:05},Closed,caf\u00e9 \u20ac {i}\n" for i in range(4000))).encode("cp1252"))
    found = files.read_incidents_csv(spark, str(folder)).select("number", "state", "short_description")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        for encoding in ("windows-1252", "cp1252"):
            given = files.read_incidents_csv(spark, str(folder), multi_line=False, encoding=encoding, same_header=True)
            plan = given._jdf.queryExecution().executedPlan().toString()
            assert plan.count("FileScan") == 1 and "FileScan csv" in plan
            assert given.rdd.getNumPartitions() > 8
            assert sorted(map(tuple, given.select("number", "state", "short_description").collect())) == sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["short_description"][:6] for r in found.collect()} == {"caf\u00e9 \u20ac"}


def test_missing_org_map_is_empty(spark, tmp_path):
    assert files.read_org_map(spark, str(tmp_path / "none.csv")).count() == 0


def test_append_new_is_idempotent(spark, incidents, tmp_path):
    path = str(tmp_path / "table")
    part = incidents.where("month < '1999-01'")
    assert sinks.append_new(spark, part, path) == part.count()
    n = incidents.count()
    assert sinks.append_new(spark, incidents, path) == n - part.count()
    assert sinks.append_new(spark, incidents, path) == 0
    twice = incidents.limit(5).withColumn("number", F.concat(F.lit("NEW"), "number"))
    twice = twice.withColumn("state", F.lit("newest")).unionByName(
        twice.withColumns({"state": F.lit("older"), "updated": F.col("updated") - F.expr("INTERVAL 2 DAYS")}))
    blank = incidents.limit(2).withColumn("number", F.lit(None).cast("string")).unionByName(incidents.limit(2).withColumn("number", F.lit(" ")))
    assert sinks.append_new(spark, twice.unionByName(blank), path) == 5
    assert sinks.read_clean(spark, path).where("number LIKE 'NEW%'").select("state").distinct().collect() == [("newest",)]
    assert sinks.append_new(spark, twice.unionByName(blank), path) == 0
    n += 5
    back = sinks.read_clean(spark, path)
    assert back.count() == n
    plan = back.where("month = '1998-03'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_export_quotes_everything(spark, incidents, tmp_path):
    path = str(tmp_path / "view")
    sinks.export_csv(incidents.limit(3).coalesce(1), path)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    lines = open(os.path.join(path, part), encoding="utf-8").read().splitlines()
    assert lines[0].startswith('"number","created"') and all(x.startswith('"INC') for x in lines[1:])


def event_files(spark, folder, batches):
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "user_id int, ts string, event_type string, value double") \
            .withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(folder))
    return df.schema


def run_in_order(spark, tmp_path, batches, build, mode):
    """One batch per element, in order, through one checkpoint."""
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for b in batches:
        schema = event_files(spark, tmp_path / "in", [b])
        stream = jobs.read_files(spark, str(tmp_path / "in"), schema)
        jobs.to_changelog(build(stream), out, check, mode).awaitTermination()
    return out


BATCHES = [
    [(1, "2026-01-01 10:00:00", "a", 1.0), (1, "2026-01-01 10:20:00", "a", 2.0)],
    [(2, "2026-01-03 09:00:00", "a", 4.0), (1, "2026-01-03 09:10:00", "b", 8.0)],
    [(1, "2026-01-01 11:00:00", "a", 99.0), (2, "2026-01-03 09:30:00", "a", 16.0)],  # first row is too late
]


def test_late_rows_are_dropped(spark, tmp_path):
    out = run_in_order(spark, tmp_path, BATCHES, jobs.tumbling_kpis, "update")
    got = {(str(r["start"])[:10], r["event_type"]): (r["n"], r["total"])
           for r in jobs.read_changelog(spark, out, ["start", "event_type"]).collect()}
    assert got == {("2026-01-01", "a"): (2, 3.0), ("2026-01-03", "a"): (2, 20.0), ("2026-01-03", "b"): (1, 8.0)}


def test_sessions_close_after_gap(spark, tmp_path):
    out = run_in_order(spark, tmp_path, BATCHES, jobs.sessions, "append")
    rows = jobs.read_changelog(spark, out).collect()
    assert [(r["user_id"], r["events"], r["end"]) for r in rows] == [(1, 2, datetime(2026, 1, 1, 11, 20))]


def test_first_row_wins_in_stream_dedup(spark, tmp_path):
    batches = [[(1, "2026-01-01 10:00:00", "a", 1.0)], [(1, "2026-01-01 10:10:00", "a", 2.0), (2, "2026-01-01 10:00:00", "a", 3.0)]]
    out = run_in_order(spark, tmp_path, batches, lambda s: jobs.dedup(s, ["user_id"], "ts"), "append")
    assert sorted(r["value"] for r in jobs.read_changelog(spark, out).collect()) == [1.0, 3.0]


def test_stream_ingest_keeps_the_last_row(spark, incidents, tmp_path):
    two = incidents.limit(4)
    raw = two.withColumn("state", F.lit("Open")).unionByName(
        two.withColumns({"state": F.lit("Closed"), "updated": F.col("updated") + F.expr("INTERVAL 2 HOURS")}))
    raw.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = jobs.read_files(spark, str(tmp_path / "in"), raw.schema)
        jobs.ingest(stream, lambda df: df, str(tmp_path / "table"), str(tmp_path / f"check{_}"), ["updated"]).awaitTermination()
    rows = sinks.read_clean(spark, str(tmp_path / "table")).select("number", "state").collect()
    assert len(rows) == 4 and {r["state"] for r in rows} == {"Closed"}


def test_tickets_that_come_twice_are_derived_once(spark, tmp_path):
    from tickframe import catalog

    rows = spark.createDataFrame([("INC7", "u1", "wip"), ("INC8", "u2", "wip"), (None, "u3", "wip")], "number string, updated string, state string")
    both = catalog._some_older(rows)
    assert "Union" not in both._jdf.queryExecution().optimizedPlan().toString() and both.columns == rows.columns
    assert sorted(map(tuple, both.collect()), key=str) == sorted([
        ("INC7", "u1", "wip"), ("INC7", "1990-01-01 00:00:00", "new"), ("INC8", "u2", "wip"), (None, "u3", "wip")], key=str)
    third = catalog._arrive(both, str(tmp_path / "in"), "number")
    n = len([f for f in os.listdir(tmp_path / "in") if f.endswith(".parquet")])
    assert third == -(-n // 3)
    assert spark.read.parquet(str(tmp_path / "in")).count() == 4


def test_latest_store_deals_a_large_bucket(spark, tmp_path):
    """One bucket of many tickets is written by several tasks."""
    schema = event_files(spark, tmp_path / "in", [[(i, "2026-01-02 10:00:00", f"state {i}", 1.0) for i in range(20_000)]])
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "8"}
    kept = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        stream = jobs.read_files(spark, str(tmp_path / "in"), schema)
        jobs.latest_store(stream, "user_id", "event_type", ["ts", "event_type"], str(tmp_path / "store"), str(tmp_path / "check"),
                          buckets=1).awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    found = jobs.read_latest(spark, str(tmp_path / "store"), "user_id")
    assert found.count() == found.distinct().count() == 20_000 and len(found.inputFiles()) > 1


def test_a_late_correction_is_stored_once(spark, incidents, tmp_path):
    """A known ticket comes again under another month and under none: both paths keep the first row."""
    first = incidents.orderBy("number").limit(6).withColumn("state", F.lit("first"))
    moved = first.withColumns({"created": F.col("created") + F.expr("INTERVAL 100 DAYS"), "state": F.lit("moved")}) \
        .withColumn("month", F.date_format("created", "yyyy-MM"))
    undated = first.withColumns({"created": F.lit(None).cast("timestamp"), "month": F.lit(None).cast("string"), "state": F.lit("undated")})
    new = undated.limit(2).withColumn("number", F.concat(F.lit("N"), "number"))
    uploads = [first, moved, undated.unionByName(new), new]
    assert [sinks.append_new(spark, u, str(tmp_path / "a")) for u in uploads] == [6, 0, 2, 0]
    for i, u in enumerate(uploads):
        u.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_files(spark, str(tmp_path / "in"), first.schema)
        jobs.ingest(stream, lambda df: df, str(tmp_path / "b"), str(tmp_path / "check"), ["updated"]).awaitTermination()
    rows = [sorted((r["number"], r["state"], r["month"] or "") for r in sinks.read_clean(spark, str(tmp_path / x)).collect()) for x in "ab"]
    assert rows[0] == rows[1] and len(rows[0]) == 8 and {r[1] for r in rows[0]} == {"first", "undated"}


def test_a_repeated_batch_replaces_what_it_wrote(spark, incidents, tmp_path, monkeypatch):
    path, df = str(tmp_path / "table"), incidents.limit(40)
    sinks.append_new(spark, df.limit(10), path, batch="1")
    known = {r["number"] for r in sinks.read_clean(spark, path).collect()}

    def fails(*_):
        raise RuntimeError("lost before the index was written")

    monkeypatch.setattr(keys, "add", fails)
    with pytest.raises(RuntimeError):
        sinks.append_new(spark, df, path, batch="2")
    monkeypatch.undo()
    for _ in range(2):  # after the failure, and after a success that was not noted
        assert sinks.append_new(spark, df, path, batch="2") == 40 - len(known)
        assert sinks.read_clean(spark, path).count() == 40
    assert sinks.append_new(spark, df, path, batch="3") == 0


def test_the_index_reads_the_touched_buckets_only(spark, incidents, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_clean(incidents, path)  # a register without an index gets one
    some = incidents.limit(2)
    seen = keys.known(some, path, "next")
    assert seen.join(some.select(F.trim("number").alias("_k")), "_k", "left_semi").count() == 2
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[bucket#\d+ IN \(\d+,\d+\)|PartitionFilters: \[.*bucket#\d+ IN ", plan)
    assert seen.count() < incidents.count() / 8


def test_latest_state_over_batches(spark, tmp_path):
    out = run_in_order(spark, tmp_path, BATCHES, lambda s: jobs.latest_state(s, "user_id", "event_type", ["ts"]), "update")
    got = {r["user_id"]: (r["state"], r["updates"]) for r in jobs.read_changelog(spark, out, ["user_id"]).collect()}
    assert got == {1: ("b", 4), 2: ("a", 2)}


def test_latest_store_equals_the_batch_query(spark, tmp_path):
    """Six batches; every bucket has two slots at most; a batch that is written again changes nothing."""
    rng = random.Random(5)
    rows, store = [], str(tmp_path / "store")
    for b in range(6):
        batch = [(rng.randrange(40 if b % 2 else 5), f"2026-01-{rng.randrange(1, 28):02} 10:00:00", f"s{b}{i:02}", float(i)) for i in range(30)]
        rows += batch
        schema = event_files(spark, tmp_path / "in", [batch])
        stream = jobs.read_files(spark, str(tmp_path / "in"), schema)
        jobs.latest_store(stream, "user_id", "event_type", ["ts", "event_type"], store, str(tmp_path / "check"), buckets=4).awaitTermination()
        want = {}
        for u, ts, state, _ in rows:
            n = want.get(u, ("", "", 0))
            want[u] = (*max(n[:2], (ts, state)), n[2] + 1)
        got = {r["user_id"]: (str(r["updated"]), r["state"], r["updates"]) for r in jobs.read_latest(spark, store, "user_id").collect()}
        assert got == want
    slots = {(d, s) for d in os.listdir(store) if d.startswith("bucket=") for s in os.listdir(os.path.join(store, d)) if s.startswith("slot=")}
    assert len(slots) <= 8
    # The last batch once more, as after a failure between its write and its commit.
    commits = tmp_path / "check" / "commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        if (commits / f).exists():
            (commits / f).unlink()
    jobs.latest_store(stream, "user_id", "event_type", ["ts", "event_type"], store, str(tmp_path / "check"), buckets=4).awaitTermination()
    assert {r["user_id"]: (str(r["updated"]), r["state"], r["updates"]) for r in jobs.read_latest(spark, store, "user_id").collect()} == want


def test_clean_up_removes_this_process_s_work(spark, incidents, monkeypatch):
    from tickframe import session

    monkeypatch.setattr(session, "_RUN", "of-this-test")  # other tests' work stays
    kept = incidents.limit(3).collect()
    path = session.work_dir(spark, "some")
    incidents.limit(3).write.parquet(path)
    other = os.path.join(os.path.dirname(os.path.dirname(path)), "other")
    os.makedirs(other)
    session.clean_up(spark)
    assert not os.path.exists(path) and os.path.exists(other) and len(kept) == 3
    os.rmdir(other)
