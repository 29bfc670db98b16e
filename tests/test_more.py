"""Protocols, sinks, paging, ideas and streams that are not queries over the test tables."""

from __future__ import annotations

import json
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell import staging
from tracewell.operators import adaptation, ideas, records, research
from tracewell.sources import ingest, protocol
from tracewell.streaming import live

T0 = datetime(2024, 1, 1)


def test_counted_page(spark):
    df = spark.createDataFrame([(f"e{i}", T0 + timedelta(minutes=i)) for i in range(5)], "evidence_id string, ts timestamp_ntz")
    rows, more = records.counted_page(df, 2, 2)
    assert [r["evidence_id"] for r in rows.collect()] == ["e2", "e3"] and more == {"total": 5, "has_more": True, "next_offset": 4}
    assert records.counted_page(df, 9, 0)[1] == {"total": 5, "has_more": False, "next_offset": None}


def test_sync_and_resolver(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE agents (key TEXT, session_id TEXT, parent_key TEXT, label TEXT, started REAL, stopped REAL)")
        db.execute("CREATE TABLE actions (id INTEGER, agent_key TEXT, session_id TEXT, ts REAL, ts_end REAL, tool TEXT, input TEXT, status TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER, agent_key TEXT, session_id TEXT, ts REAL, source TEXT, text TEXT)")
        db.execute("INSERT INTO agents VALUES ('a', 's', NULL, NULL, 1704067200.5, NULL)")
        db.execute("INSERT INTO messages VALUES (1, 'a', 's', 1704067200, 'prompt', 'go')")
    root = str(tmp_path / "store")
    assert protocol.choose(spark, path).name == "recordings"
    assert protocol.sync(spark, root, path, "live") == "new" and protocol.sync(spark, root, path, "live") == "same"
    assert ingest.read(spark, root)["messages"].count() == 1
    with pytest.raises(ValueError, match="no adapter"):
        protocol.choose(spark, "x.unknown")
    monkeypatch.setattr(protocol, "ADAPTERS", {})
    protocol.mapped("m", {}, lambda spark, path: 0.4)
    assert protocol.choose(spark, "x").name == "m"
    with pytest.raises(ValueError, match="exists"):
        protocol.mapped("m", {})
    r = protocol.Resolver({})
    known = spark.createDataFrame([("e1", 1), ("e2", 2)], "evidence_id string, x int")
    r.add("msg", lambda ids: known.where("x = 1").join(ids, "evidence_id"))
    r.add("msg", lambda ids: known.withColumn("x", F.col("x") * 10).join(ids, "evidence_id"))
    got = {x["evidence_id"]: x["record"] and json.loads(x["record"])["x"] for x in r.resolve("msg", spark.createDataFrame([("e1",), ("e2",), ("e3",)], "evidence_id string")).collect()}
    assert got == {"e1": 1, "e2": 20, "e3": None}


def test_sinks(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    for i in range(2):
        ingest.append_lines(spark.createDataFrame([("f", i)], "finding_id string, line int"), log)
    assert spark.read.json(log).count() == 2
    ingest.write_payload(spark.range(3), str(tmp_path / "p.json"), "items", title="t")
    assert json.loads((tmp_path / "p.json").read_text()) == {"title": "t", "items": [{"id": 0}, {"id": 1}, {"id": 2}]}
    monkeypatch.setattr(ingest, "PAYLOAD_ROWS", 2)
    with pytest.raises(ValueError, match="at most"):
        ingest.write_payload(spark.range(3), str(tmp_path / "q.json"))


def test_watch_goes_on_where_it_ended(spark, tmp_path):
    seen = []
    for i in range(2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"x": i}))
        live.watch(spark, str(tmp_path / "in"), "x int", lambda df, n: seen.append(sorted(r["x"] for r in df.collect())), str(tmp_path / "checkpoint")).awaitTermination()
    assert seen == [[0], [1]]


def test_staged_tables_are_swept(spark, monkeypatch):
    import os

    df = staging.stage(spark.range(3))
    path = df.inputFiles()[0].removeprefix("file://")
    monkeypatch.setattr(staging, "_LIVE", {k: v for k, v in staging._LIVE.items() if k in path})
    assert df.count() == 3
    staging.sweep()
    assert not os.path.exists(path)


def test_presence_and_spread(spark):
    t = lambda d: T0 + timedelta(days=d)
    people = spark.createDataFrame([("a", t(0), True, None), ("b", t(1), True, t(2)), ("c", t(5), False, None)], "agent_id string, joined_ts timestamp_ntz, listed boolean, left_ts timestamp_ntz")
    said = spark.createDataFrame([("m1", "c1", "a", t(1)), ("m2", "c1", "b", t(3)), ("m3", "c2", "b", t(4)), ("m4", "c1", "c", t(6)), ("m5", "c1", "c", t(7)), ("m6", "c1", "a", t(30))], "evidence_id string, channel string, author_id string, ts timestamp_ntz")
    there = ideas.presence(people, said)
    assert {r["agent_id"]: r["until_ts"] for r in there.collect()} == {"a": t(30), "b": t(4), "c": t(7)}
    rows = {r["adopter"]: (r["origin"], r["present"], r["newcomer"], r["soon"], r["adopter_room"]) for r in ideas.spread(said.withColumn("term", F.lit("zig")), there).collect()}
    assert rows == {"b": ("a", 2, False, True, "c1"), "c": ("a", 2, True, True, "c1")}
    seeded = spark.createDataFrame([("zig", t(2))], "term string, seeded_ts timestamp_ntz")
    out = ideas.spread(said.withColumn("term", F.lit("zig")), there, seeded)
    assert all(r["seeded"] for r in out.collect()) and ideas.speed(out, t(60)).count() == 0
    kinds = spark.createDataFrame([(0.4,), (0.55,), (0.6,)], "b double").select(ideas.kind(F.col("b")).alias("k")).collect()
    assert [k["k"] for k in kinds] == ["durable", None, "episodic"]


def test_confusable_names(spark):
    rows = [(1, "Agent 7"), (2, "agent-7"), (3, "Аgent 7"), (4, "Bot 22"), (5, "Bot 69"), (6, "Same"), (7, "Same"), (8, "ﬁx"), (9, "FIX"), (10, None)]
    got = {r["skeleton"]: (r["ids"], r["kind"]) for r in research.confusable_names(spark.createDataFrame(rows, "agent_id int, name string")).collect()}
    assert got == {"agent7": ([3, 1, 2], "homoglyph"), "fix": ([8, 9], "homoglyph")}


def test_first_exposures_are_those_of_all_messages(spark):
    import random

    rng = random.Random(5)
    said = [(f"m{i}", rng.choice("xy"), rng.choice(["p", "q", "r", "s", None]), T0 + timedelta(minutes=rng.choice([0, 60, 120, 121]) + 60 * rng.randrange(200)), rng.choice(["t1", "t2", "t3"])) for i in range(300)]
    rows = spark.createDataFrame(said, "evidence_id string, channel string, author_id string, ts timestamp_ntz, term string")
    uses = rows.where("term <> 't3' OR author_id = 'p'")
    want = {}
    for _, room, by, at, term in said:
        for _, other, reader, when, _ in said:
            if room == other and by and reader and by != reader and abs(at - when) <= timedelta(hours=2) and (term != "t3" or by == "p"):
                want[term, reader] = min(want.get((term, reader), at), at)
    got = {(r["term"], r["reader"]): T0 + timedelta(milliseconds=r["first_exposed"] - 1704067200000) for r in research.exposures(uses, rows).collect()}
    assert got == want


def test_exposures_join_no_uses_with_messages(spark):
    rows = spark.createDataFrame([("m", "x", "p", T0, "t")], "evidence_id string, channel string, author_id string, ts timestamp_ntz, term string")
    plan = research.exposures(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_markers_are_words_of_ascii(spark):
    rows = spark.createDataFrame([("u", "chung undüöein"), ("u", "hund"), ("u", "Und_so"), ("u", "so UND.")], "role string, content string")
    assert research.marker_rates(rows, ["role"], {"und": r"\bund\b"}).first()["und"] == 50.0


def test_session_ends_among_boundaries_of_one_moment(spark):
    at = lambda us: T0 + timedelta(microseconds=us)
    sessions = spark.createDataFrame([("w", s, "a", at(0)) for s in ("s1", "s2", "s9")] + [("w", "s3", "a", at(5))], "window string, session string, agent string, ts timestamp_ntz")
    ends = [("s1", 5, "start"), ("s9", 5, "consolidate"), ("s9", 7, "start"), ("s4", 9, "consolidate")]
    b = spark.createDataFrame([("w", "a", at(us), kind, s) for s, us, kind in ends], "window string, agent string, ts timestamp_ntz, kind string, session string")
    got = {r["session"]: (r["end_ts"], r["end_reason"]) for r in adaptation.session_spans(sessions, b).collect()}
    assert got["s1"] == (at(5), "consolidate") and got["s9"] == (at(5), "next-start") and got["s2"][0] == at(5) and got["s3"] == (at(7), "next-start")
    # s9's own row alone at the next moment, then one with another beside it.
    b = spark.createDataFrame([("w", "a", at(us), "start", s) for s, us in [("s9", 3), ("s9", 5), ("s1", 5), ("s4", 9)]], "window string, agent string, ts timestamp_ntz, kind string, session string")
    assert {r["session"]: r["end_ts"] for r in adaptation.session_spans(sessions, b).collect()} == {"s1": at(3), "s2": at(3), "s9": at(5), "s3": at(9)}


def test_weekly_hazard_joins_no_uses_with_messages(spark):
    from tracewell.registry import QUERIES

    plan = QUERIES["idea_weekly_hazard"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_exposures_write_two_authors_of_a_moment_and_no_late_readers(spark, monkeypatch):
    wrote, stage = {}, research.stage
    monkeypatch.setattr(research, "stage", lambda df, name: wrote.setdefault((name, len(wrote)), stage(df, name)))
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    rows = [(f"m{i}", "x", f"a{i:02}", T0, "t") for i in range(20)] + [(f"n{i}-{j}", "x", f"a{i:02}", at(300 * j), "t") for i in (0, 7, 19) for j in (1, 2, 3)] + [("o", "y", "z", at(9), "t"), ("p", "x", "z", at(30), "t")]
    df = spark.createDataFrame(rows, "evidence_id string, channel string, author_id string, ts timestamp_ntz, term string")
    got = {(r["term"], r["reader"]): r["first_exposed"] for r in research.exposures(df, df).collect()}
    start = min(got.values())
    assert got == {("t", r): start for r in [*{f"a{i:02}" for i in range(20)}, "z"]}
    n = {name: t.count() for (name, _), t in wrote.items()}
    assert n["uses"] == 2 + 2 * 3 + 2 and n["readers"] == 0
