from __future__ import annotations

import gzip
import json
import sqlite3
from datetime import datetime, timedelta

from tracewell.operators import views
from tracewell.sources import adapters

T0 = datetime(2024, 1, 1)


def dump(path, rows):
    with gzip.open(path, "wt") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def test_agent_rooms(spark, tmp_path):
    at = lambda m: f"2024-01-01 00:{m:02d}:00.000000"
    dump(tmp_path / "agents.jsonl.gz", [{"id": "1", "name": "Ada 2", "model_string": "m", "created_at": at(0), "is_participating": True}, {"id": "2", "name": "Bob", "is_participating": False}, {"id": "3", "name": "Cyd", "is_participating": False}])
    dump(tmp_path / "chat_rooms.jsonl.gz", [{"id": "r", "name": "general"}])
    dump(tmp_path / adapters.GOALS_FILE, [{"id": "g", "goal": "Hold a competition", "start_time": at(0), "end_time": None}])
    dump(tmp_path / "chat_messages.jsonl.gz", [
        {"id": "m1", "agent_speaker_id": "1", "speaker_type": "agent", "content": "Ada and bob, go", "room_id": "r", "created_at": at(2)},
        {"id": "m2", "user_speaker_id": "u", "speaker_type": "user", "content": None, "room_id": "x", "created_at": at(1)},
    ])
    dump(tmp_path / "events.jsonl.gz", [
        {"id": "e1", "created_at": at(3), "data": {"actionType": "START_COMPUTER_USE_SESSION", "agentId": "2", "sessionGoal": "do", "computerUseSessionId": "s"}},
        {"id": "e2", "created_at": at(4), "data": {"actionType": "AGENT_TALK", "agentId": "1", "content": "WAIT"}},
    ])
    out = adapters.agent_rooms(spark, str(tmp_path))
    m = {r["evidence_id"]: r for r in out["messages"].collect()}
    assert m["rooms:msg:m1"]["recipient_ids"] == ["rooms:agent:2"] and m["rooms:msg:m1"]["channel"] == "general"
    assert m["rooms:msg:m2"]["author_id"] == "human:u" and m["rooms:msg:m2"]["channel"] == "x" and m["rooms:msg:m2"]["recipient_ids"] == []
    assert [(r["agent_id"], r["kind"], r["content"]) for r in out["actions"].collect()] == [("rooms:agent:2", "start_computer_use_session", "do")]
    assert sorted(r["agent_id"] for r in out["agents"].collect()) == ["rooms:agent:1", "rooms:agent:2"]  # the third did nothing
    assert out["periods"].first()["goal_kind"] == "competition"


def test_wiki(spark):
    pages = spark.createDataFrame([("p", "Home"), ("q", "Plan")], "page_key string, name string")
    rev = spark.createDataFrame([(1, "p", 1, "ann", "2024-01-01T00:00:00Z", "a\nb"), (2, "p", 2, "bob", "2024-01-02T00:00:00Z", "a\nb\nsee [[plan]]"), (3, "p", 3, "bob", "2024-01-03T00:00:00Z", "a")],
                                "revision_id int, page_key string, sequence int, label string, time string, body string")
    out = adapters.wiki(pages, rev)
    assert {r["evidence_id"]: r["content"] for r in out["messages"].collect()} == {"wiki:msg:1": "a\nb", "wiki:msg:2": "see [[plan]]"}
    assert sorted((r["record_id"][-1], r["op"], r["artifact_id"][-1]) for r in out["touches"].collect()) == [("1", "create", "p"), ("2", "mention", "q"), ("2", "modify", "p"), ("3", "delete", "p")]


def test_recordings(spark, tmp_path):
    path = str(tmp_path / "rec.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE agents (key TEXT, session_id TEXT, label TEXT, parent_key TEXT, started REAL, stopped REAL)")
        db.execute("CREATE TABLE actions (id INTEGER, agent_key TEXT, session_id TEXT, ts REAL, ts_end REAL, tool TEXT, input TEXT, status TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER, agent_key TEXT, session_id TEXT, ts REAL, source TEXT, text TEXT)")
        db.execute("INSERT INTO agents VALUES ('a', 's', NULL, NULL, 1704067200.5, NULL)")
        db.executemany("INSERT INTO actions VALUES (?, 'a', 's', ?, ?, ?, ?, ?)", [(1, 1704067201, 1704067202, "Write", '{"file_path": "x.py"}', "ok"), (2, 1704067203, None, "Edit", '{"file_path": "x.py"}', "ok"), (3, 1704067204, None, "Read", '{"file_path": "x.py"}', None), (4, 1704067205, None, "Write", '{"file_path": "y"}', "error")])
        db.execute("INSERT INTO messages VALUES (1, 'a', 's', 1704067200, 'prompt', 'go')")
    out = adapters.recordings(spark, path)
    assert sorted((r["record_id"][-1], r["op"]) for r in out["touches"].collect()) == [("1", "create"), ("2", "modify"), ("3", "read")]
    assert out["agents"].first()["first_seen"] == T0 + timedelta(milliseconds=500) and out["periods"].first()["end_ts"] == T0 + timedelta(seconds=5)
    assert out["messages"].first()["msg_type"] == "prompt" and out["artifacts"].count() == 1


def test_landed(spark):
    commits = spark.createDataFrame([("c1", [], "p1"), ("c2", ["c1"], "p2")], "sha string, parents array<string>, patch_id string")
    pulls = spark.createDataFrame([(1, "h", "c2", ["z"], True), (2, "c1", None, [], True), (3, "h", None, ["p1", "p2"], True), (4, "h", None, ["p1", "z"], True), (5, "h", None, [], False)], "pull int, head_sha string, merge_sha string, patch_ids array<string>, closed boolean")
    assert {r["pull"]: r["state"] for r in adapters.landed(commits, pulls).collect()} == {1: "merged", 2: "landed", 3: "landed", 4: "unmerged", 5: "open"}


def test_views(spark):
    e = spark.createDataFrame([("a", T0), ("b", T0 - timedelta(days=1))], "id string, ts timestamp_ntz")
    links = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    assert {r["problem"]: r["n"] for r in views.trace_problems(e, links).collect()} == {"edge_to_nowhere": 1, "edge_back_in_time": 1}
