from __future__ import annotations

import gzip
import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.sources import ingest, mapping, readers
from tracewell.streaming import live


@pytest.fixture
def dataset(tmp_path):
    with gzip.open(tmp_path / "chat.jsonl.gz", "wt") as f:
        for i in range(20):
            f.write(json.dumps({"uid": i, "meta": {"at": f"2024-01-01T00:{i:02d}:00Z", "chan": "#a"}, "who": {"ref": f"u{i % 3}"}, "body": f"hello {i}", "to": "u1; u2"}) + "\n")
        f.write("{not json\n")
    (tmp_path / "people.json").write_text(json.dumps({"people": [{"pid": f"u{i}", "label": f"Person {i}"} for i in range(3)]}))
    (tmp_path / "flat.csv").write_text("No;said\n1;hi\n2;\n")
    with sqlite3.connect(tmp_path / "forum.sqlite") as db:
        db.execute("CREATE TABLE posts (k INTEGER, body TEXT, score REAL)")
        db.executemany("INSERT INTO posts VALUES (?, ?, ?)", [(i, None if i == 3 else f"p{i}", i / 2) for i in range(50)])
        db.execute("CREATE TABLE empty (k INTEGER)")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.json").write_text("[]")
    return str(tmp_path)


def test_discovery_and_readers(spark, dataset):
    found = readers.tables(spark, dataset)
    assert sorted(found) == ["chat.jsonl.gz", "flat.csv", "forum.sqlite#empty", "forum.sqlite#posts", "people.json#people"]
    assert readers.bad_lines(found["chat.jsonl.gz"].cache()).count() == 1
    assert [tuple(r) for r in found["flat.csv"].orderBy("No").collect()] == [("1", "hi"), ("2", None)]
    posts = found["forum.sqlite#posts"]
    assert posts.count() == 50 and posts.agg(F.sum("score")).first()[0] == 612.5
    assert found["forum.sqlite#empty"].count() == 0
    assert set(readers.matching(found, "forum*")) == {"forum.sqlite#empty", "forum.sqlite#posts"}


def test_sniffing():
    assert readers.sniff_delimiter("a|b|c\n1|2,2|3") == "|"
    assert readers.sniff_delimiter("just text") == ","


MAPPING = {
    "messages": {
        "from": "chat*", "where": [["uid", "exists"], ["uid", "!=", 4]],
        "fields": {
            "evidence_id": "uid", "ts": {"path": "meta.at", "time": "iso"}, "channel": {"path": "meta.chan", "values": {"#a": "alpha"}}, "content": "body", "recipient_ids": {"path": "to", "split": ";"},
            "author_id": {"path": "who.ref", "lookup": {"from": "people*", "key": "pid", "value": "label"}}, "msg_type": {"path": "nowhere.at.all", "default": "chat"},
        },
    }
}


def test_mapping_profile_and_check(spark, dataset):
    found = readers.tables(spark, dataset)
    out = mapping.apply(MAPPING, found, "src")
    m = out["messages"]
    first = m.orderBy("ts").first()
    assert m.count() == 19 and first["evidence_id"] == "src:msg:0" and first["channel"] == "alpha" and first["author_id"] == "Person 0"
    assert first["recipient_ids"] == ["u1", "u2"] and first["ts"] == datetime(2024, 1, 1) and first["msg_type"] == "chat"
    assert out["agents"].count() == 3
    named = mapping.resolved_authors(m, out["agents"])
    assert named.select("author_id").distinct().count() == 3 and named.first()["author_id"].startswith("src:agent:")
    assert mapping.check(out).count() == 0
    bad = mapping.check({"messages": m.union(m.limit(1)).withColumn("reply_to", F.lit("src:msg:99"))})
    assert {(r["code"], r["n"]) for r in bad.collect()} == {("id_repeated", 2), ("reply_unresolved", 20)}
    p = {r["field"]: r for r in mapping.profile(found["chat.jsonl.gz"].select("uid", F.col("meta.at").alias("sent_at"), "body")).collect()}
    assert p["sent_at"]["role"] == "time" and p["sent_at"]["time_rate"] == 1.0 and p["body"]["role"] == "text"
    drafted = mapping.draft({"t": list(p.values())}, "t")
    assert drafted["messages"]["fields"]["ts"] == {"path": "sent_at", "time": "auto"}
    fk = mapping.foreign_key_overlap(found["chat.jsonl.gz"].select(F.col("who.ref").alias("r")), "r", found["people.json#people"], "pid").first()
    assert fk["overlap"] == 1.0


def test_ingest_replaces_by_source(spark, dataset, tmp_path):
    root = str(tmp_path / "store")
    out = mapping.apply(MAPPING, readers.tables(spark, dataset), "src")
    assert ingest.ingest(spark, root, "src", out, "a") == "new"
    assert ingest.ingest(spark, root, "src", out, "a") == "same"
    other = {"messages": out["messages"].limit(2).withColumn("evidence_id", F.concat(F.lit("x"), "evidence_id"))}
    assert ingest.ingest(spark, root, "two", other, "b") == "new"
    assert ingest.ingest(spark, root, "src", {"messages": out["messages"].limit(5)}, "a") == "replaced"
    got = {r["source"]: r["n"] for r in ingest.read(spark, root)["messages"].groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got == {"src": 5, "two": 2}
    with pytest.raises(ingest.SourceConflict):
        ingest.ingest(spark, root, "src", out, "somebody else")
    with pytest.raises(ValueError, match="repeated keys"):
        ingest.ingest(spark, root, "three", {"messages": out["messages"].union(out["messages"])}, "c")
    before = ingest.read(spark, root)["messages"].count()
    dead, share = ingest.garbage(spark, root)
    assert dead and 0 < share < 1 and ingest.compact(spark, root, least=0.999) == "kept"
    assert ingest.compact(spark, root, least=0.0) == "compacted"
    assert ingest.read(spark, root)["messages"].count() == before and ingest.garbage(spark, root) == ([], 0.0)


def test_of_two_writers_at_once_one_fails(spark, dataset, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    out = mapping.apply(MAPPING, readers.tables(spark, dataset), "src")
    ingest.ingest(spark, root, "src", out, "a")
    seen = ingest.current(spark, root)
    few = {"messages": out["messages"].limit(2)}
    assert ingest.ingest(spark, root, "two", few, "b") == "new"
    monkeypatch.setattr(ingest, "current", lambda *_: seen)  # as a writer that looked before the other was done
    with pytest.raises(ingest.SourceConflict):
        ingest.ingest(spark, root, "three", few, "c")
    monkeypatch.undo()
    assert set(ingest.current(spark, root)[1]) == {"src", "two"}


def test_export_and_check(spark, tmp_path):
    df = spark.createDataFrame([("s:msg:1", "s", "msg", "mail a@b.example"), ("s:msg:2", "s", "msg", None)], "evidence_id string, source string, kind string, text string")
    path = str(tmp_path / "out")
    m = ingest.export(df, path)
    assert m["redacted"] == {"email": 1} and m["rows"] == 2
    assert ingest.check_export(spark, path) == []
    (tmp_path / "out" / "stray.txt").write_text("x")
    assert ingest.check_export(spark, path) == ["unlisted: stray.txt"]


def _write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def event(i, minute, kind, agent="a", call=None, text=None):
    return {"id": i, "ts": f"2024-01-01T00:{minute:02d}:00Z", "session_id": "s", "agent_key": agent, "event": kind, "call_id": call, "tool": "t", "text": text}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "1.json", [event(1, 0, "message", text="x"), event(2, 1, "message", text="x"), event(3, 2, "message", text="y"), event(4, 3, "call", call="c"), event(5, 4, "result", call="c", text="ok")])
    stream = live.events(spark, str(src))
    live.drain(live.messages_once(stream), str(tmp_path / "m"), str(tmp_path / "cm"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    _write(src, "2.json", [event(6, 5, "message", text="y"), event(7, 6, "message", agent="b", text="y")])
    live.drain(live.messages_once(live.events(spark, str(src))), str(tmp_path / "m"), str(tmp_path / "cm"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    live.drain(live.completed_calls(live.events(spark, str(src))), str(tmp_path / "c"), str(tmp_path / "cc"))
    row = spark.read.parquet(str(tmp_path / "c")).first()
    assert (row["call_id"], row["output"]) == ("c", "ok")


def test_windows_match_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _write(src, "1.json", [event(i, m, "x", agent="ab"[i % 2]) for i, m in enumerate([0, 5, 10, 45, 50, 59])])
    got = []
    live.drain_each(live.counted(live.events(spark, str(src)), "30 minutes", ["agent_key"]), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "c"), "complete")
    batch = spark.read.schema(live.EVENT).json(str(src)).groupBy(F.window("ts", "30 minutes").start.alias("b"), "agent_key").agg(F.count("*").alias("n"))
    assert sorted(got) == sorted(map(tuple, batch.collect()))
    got.clear()
    live.drain_each(live.sessions(live.events(spark, str(src)), gap="20 minutes"), lambda df, _: got.extend((r["agent_key"], r["n"]) for r in df.collect()), str(tmp_path / "c2"), "complete")
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_upsert_and_running(spark, tmp_path):
    src, state = tmp_path / "in", str(tmp_path / "state")
    src.mkdir()
    _write(src, "1.json", [event(1, 0, "call", call="c")])
    live.drain_each(live.events(spark, str(src)), live.upsert(state, "call_id"), str(tmp_path / "c"))
    _write(src, "2.json", [event(2, 1, "result", call="c", text="ok")])
    live.drain_each(live.events(spark, str(src)), live.upsert(state, "call_id"), str(tmp_path / "c"))
    assert [(r["event"], r["text"]) for r in spark.read.parquet(f"{state}/1").collect()] == [("result", "ok")]
    rows = spark.read.schema(live.EVENT).json(str(src))
    assert live.running(rows, datetime(2024, 1, 1, 0, 2)).first()["running"] is True
    assert live.running(rows, datetime(2024, 1, 1, 0, 9)).first()["running"] is False
