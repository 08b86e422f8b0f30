from __future__ import annotations

import json
import sqlite3
import zipfile

import pytest

from threadlode.sources import keyvalue, transcripts
from threadlode.streaming.ingest import FILES, SLOTS, SessionTable, ingest_stream


def _rows(df):
    return {r["id"]: r for r in df.collect()}


def test_jsonl_skips_bad_lines(spark, tmp_path):
    good = {"source": "x", "native_id": "1", "started_at": "2025-01-02T03:04:05Z", "messages": [{"role": "user", "text": " hi "}, {"role": "tool", "text": "no"}, {"role": "assistant", "text": "  "}]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.jsonl").write_text("\n".join([json.dumps(good), "[]", "junk", "", json.dumps({"source": "x"}), json.dumps({**good, "native_id": "2", "messages": []})]))
    got = _rows(transcripts.read_jsonl(spark, str(tmp_path)))
    assert [*got] == ["x:1"] and [m["text"] for m in got["x:1"]["messages"]] == [" hi "] and got["x:1"]["title"] == " hi " and got["x:1"]["started_at"] is not None


def test_logs(spark, tmp_path):
    line = lambda **k: json.dumps(k)
    (tmp_path / "one.jsonl").write_text("\n".join([
        line(type="summary"), "broken {", line(type="user", sessionId="other", timestamp="2025-01-01T00:00:00Z", message={"role": "user", "content": "<command-name>x</command-name>"}),
        line(type="assistant", timestamp="2025-01-01T00:00:09Z", message={"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use"}, {"type": "text", "text": "b"}]}),
        line(type="user", isSidechain=True, message={"role": "user", "content": "side"}),
    ]))
    (tmp_path / "side.jsonl").write_text(line(type="user", isSidechain=True, message={"role": "user", "content": "side"}))
    (tmp_path / "judge.jsonl").write_text(line(type="user", message={"role": "user", "content": "<system-reminder>a</system-reminder>  You are a judge now"}))
    got = _rows(transcripts.read_logs(spark, str(tmp_path), source="cli", markers=("You are a judge",)))
    assert [*got] == ["cli:one"]
    assert [m["text"] for m in got["cli:one"]["messages"]][1] == "a\nb" and got["cli:one"]["title"] == "a\nb" and got["cli:one"]["ended_at"].second == 9


def test_export_branch_cycle_and_zip(spark, tmp_path):
    node = lambda p, r, t: {"parent": p, "children": [], "message": {"author": {"role": r}, "create_time": 1.7e9, "content": {"content_type": "text", "parts": [t]}}}
    tree = {"root": {"parent": None, "message": None}, "a": node("root", "user", " q "), "b": node("a", "assistant", "old"), "c": node("a", "assistant", "new"), "x": node("y", "user", "1"), "y": node("x", "user", "2")}
    data = [{"id": "k", "title": "T", "create_time": 1.7e9, "current_node": "c", "mapping": tree}, {"conversation_id": "loop", "title": None, "current_node": "x", "mapping": tree}, {"id": "gone", "current_node": "nowhere", "mapping": tree}]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "conversations.json").write_text(json.dumps(data))
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "e.zip", "w") as z:
        z.writestr("conversations.json", json.dumps(data))
    (tmp_path / "z" / "bad.zip").write_text("no zip")
    plain, zipped = (_rows(transcripts.read_export(spark, str(tmp_path / d))) for d in "pz")
    assert plain == zipped and [m["text"] for m in plain["chat-export:k"]["messages"]] == ["q", "new"]
    assert [m["text"] for m in plain["chat-export:loop"]["messages"]] == ["2", "1"] and len(plain) == 2


def test_stores(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.vscdb")
    con.execute("create table ItemTable (key text, value blob)")
    con.execute("create table cursorDiskKV (key text, value blob)")
    con.execute("insert into ItemTable values (?, ?)", ("workbench.panel.aichat.view.aichat.chatdata", json.dumps({"tabs": [{"tabId": "t1", "chatTitle": "C", "bubbles": [{"type": "user", "text": "hi"}, {"type": "ai", "text": "yo"}]}]})))
    con.execute("insert into ItemTable values ('ui.state', '{}')")
    con.execute("insert into cursorDiskKV values (?, ?)", ("composerData:c1", json.dumps({"composerId": "c1", "fullConversationHeadersOnly": [{"bubbleId": "b2", "type": 1}, {"bubbleId": "b1", "type": 2}]})))
    con.execute("insert into cursorDiskKV values (?, ?)", ("bubbleId:c1:b1", json.dumps({"text": "second"})))
    con.execute("insert into cursorDiskKV values (?, ?)", ("bubbleId:c1:b2", json.dumps({"text": "first"})))
    con.execute("insert into cursorDiskKV values (?, ?)", ("composerData:empty", json.dumps({"composerId": "empty"})))
    con.commit()
    (tmp_path / "bad.vscdb").write_text("not a database")
    kv = keyvalue.read_stores(spark, spark.createDataFrame([(str(tmp_path / n),) for n in ("a.vscdb", "bad.vscdb", "none.vscdb")], "path string"))
    tabs, composers = _rows(keyvalue.best_of(keyvalue.generic_sessions(kv, "ed", keyvalue.FLAVOURS["cursor"][1]))), _rows(keyvalue.best_of(keyvalue.composer_sessions(kv, "ed")))
    assert [*tabs] == ["ed:t1"] and [(m["role"], m["text"]) for m in tabs["ed:t1"]["messages"]] == [("user", "hi"), ("assistant", "yo")]
    assert [*composers] == ["ed:c1"] and [(m["role"], m["text"]) for m in composers["ed:c1"]["messages"]] == [("user", "first"), ("assistant", "second")]


def test_stream_replaces_by_key(spark, tmp_path):
    put = lambda n, *texts: (tmp_path / "in" / n).write_text("\n".join(json.dumps({"source": "s", "native_id": k, "messages": [{"role": "user", "text": t}]}) for k, t in texts))
    (tmp_path / "in").mkdir()
    table = SessionTable(spark, str(tmp_path / "table"))
    assert table.current().count() == 0
    for name, texts in (("a", [("1", "x"), ("2", "y")]), ("b", [("2", "z"), ("3", "w")])):
        put(name, *texts)
        ingest_stream(spark, str(tmp_path / "in"), table, str(tmp_path / "cp")).awaitTermination()
    assert {r["native_id"]: r["messages"][0]["text"] for r in table.current().collect()} == {"1": "x", "2": "z", "3": "w"}


def _store(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(path)
    con.execute("create table ItemTable (key text, value blob)")
    con.execute("create table cursorDiskKV (key text, value blob)")
    for table, key, value in rows:
        con.execute(f"insert into {table} values (?, ?)", (key, json.dumps(value) if not isinstance(value, str) else value))
    con.commit()
    con.close()


def test_editors_are_found_and_read(spark, tmp_path):
    home = tmp_path / "home"
    say = lambda *t: [{"type": "user", "text": x} for x in t]
    chat = "workbench.panel.aichat.view.aichat.chatdata"
    _store(home / ".config/Cursor/User/workspaceStorage/w1/state.vscdb", [("ItemTable", chat, {"tabs": [{"tabId": "t", "bubbles": say("one")}, 5]}), ("ItemTable", "other.chat", {"messages": say("no")}), ("ItemTable", chat + "2", "not json")])
    _store(home / ".config/Cursor/User/workspaceStorage/w2/state.vscdb", [("ItemTable", chat, {"tabs": [{"tabId": "t", "bubbles": say("one", "two")}]})])
    composer = {"composerId": "c", "name": "N" * 80, "createdAt": 1.7e12, "lastUpdatedAt": "2025-01-02T03:04:05Z", "conversation": say("hi")}
    _store(home / ".config/Cursor/User/globalStorage/state.vscdb", [("cursorDiskKV", "composerData:c", composer)])
    _store(tmp_path / "mnt/c/Users/me/AppData/Roaming/Windsurf/User/globalStorage/state.vscdb", [("ItemTable", "codeium.state", {"proto": "AAA="})])
    roots = {f: keyvalue.editor_roots(f, str(home), str(tmp_path)) for f in keyvalue.FLAVOURS}
    assert [len(r) for r in roots.values()] == [1, 1, 0] and len(keyvalue.store_paths(roots["cursor"])) == 3
    got = _rows(keyvalue.read_editor(spark, "cursor", roots["cursor"]))
    assert sorted(got) == ["cursor:c", "cursor:t"] and len(got["cursor:t"]["messages"]) == 2
    c = got["cursor:c"]
    assert c["title"] == "N" * 60 and c["started_at"].year == 2023 and c["ended_at"].day == 2
    assert [tuple(r) for r in keyvalue.detected(spark, roots).collect()] == [("antigravity", 0, 0, "no store"), ("cursor", 3, 2, "read"), ("windsurf", 1, 0, "no chats in its stores: skipped")]


def test_spellings_of_messages(spark):
    m = [{"role": "user", "text": "", "content": " kept\t", "timestamp": "2025-03-04T05:06:07Z"}, {"author": "bot", "message": "m", "created_at": 1700000000}, {"type": 2, "text": "t", "createdAt": 1700000000000}, {"role": "User", "text": "no"}, {"role": "user", "text": "  "}]
    df = spark.createDataFrame([("p", "ItemTable", "agent.session.x", json.dumps(m)), ("p", "ItemTable", "agent.session.y", json.dumps({"conversation": [], "messages": m}))], "path string, tab string, key string, value string")
    (row,) = keyvalue.editor_sessions(df, "antigravity").collect()  # the first list counts, though it is empty
    assert [(x["role"], x["text"]) for x in row["messages"]] == [("user", "kept"), ("assistant", "m"), ("assistant", "t")]
    assert [x["ts"].year for x in row["messages"]] == [2025, 2023, 2023] and row["title"] == "kept"


def test_only_touched_buckets_are_written(spark, tmp_path):
    from threadlode.sources.transcripts import parse_jsonl

    table = SessionTable(spark, str(tmp_path / "t"), 8)
    lines = lambda ids, text: spark.createDataFrame([(json.dumps({"source": "s", "native_id": str(k), "messages": [{"role": "user", "text": text}]}),) for k in ids], "value string")
    table.apply(parse_jsonl(lines(range(40), "old")))
    table.apply(parse_jsonl(lines([3], "new")))
    assert sorted(table.manifest().slots.values()) == [0] * 7 + [1] and len(list((tmp_path / "t" / "data").glob("bucket=*/slot=1"))) == 1
    assert sorted(r["messages"][0]["text"] for r in table.current().collect()) == ["new"] + ["old"] * 39


def _session(spark, **texts):
    from threadlode.sources.transcripts import parse_jsonl

    return parse_jsonl(spark.createDataFrame([(json.dumps({"source": "s", "native_id": k, "messages": [{"role": "user", "text": t}]}),) for k, t in texts.items()], "value string"))


def _texts(table):
    return {r["native_id"]: r["messages"][0]["text"] for r in table.current().collect()}


def test_replayed_batches_change_nothing(spark, tmp_path):
    table = SessionTable(spark, str(tmp_path / "t"), 4)
    assert table.apply(_session(spark, a="1"), "one", 0) and table.apply(_session(spark, a="2"), "one", 1)
    assert not table.apply(_session(spark, a="1"), "one", 0) and not table.apply(_session(spark, a="other"), "one", 1)
    assert _texts(table) == {"a": "2"} and table.apply(_session(spark, b="3"), "two", 0) and _texts(table) == {"a": "2", "b": "3"}
    assert table.apply(_session(spark), "one", 2) and table.manifest().batches == {"one": 2, "two": 0} and _texts(table) == {"a": "2", "b": "3"}


def test_a_stream_is_known_by_its_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = SessionTable(spark, str(tmp_path / "t"), 4)
    for k in range(2):
        (tmp_path / "in" / str(k)).write_text(json.dumps({"source": "s", "native_id": "a", "messages": [{"role": "user", "text": str(k)}]}))
        ingest_stream(spark, str(tmp_path / "in"), table, str(tmp_path / "cp")).awaitTermination()
    stream = json.loads((tmp_path / "cp" / "metadata").read_text())["id"]
    assert table.manifest().batches == {stream: 1} and _texts(table) == {"a": "1"}


def test_a_batch_that_dies_leaves_the_last_state(spark, tmp_path, monkeypatch):
    table = SessionTable(spark, str(tmp_path / "t"), 2)
    table.apply(_session(spark, a="1", b="1", c="1"), "s", 0)
    with monkeypatch.context() as m:
        m.setattr(SessionTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        for _ in range(4):  # also when it dies more often than there are slots
            with pytest.raises(RuntimeError, match="lost"):
                table.apply(_session(spark, a="2", d="2"), "s", 1)
            assert _texts(table) == {"a": "1", "b": "1", "c": "1"}
    assert table.apply(_session(spark, a="2", d="2"), "s", 1) and _texts(table) == {"a": "2", "b": "1", "c": "1", "d": "2"}
    with pytest.raises(ValueError, match="has 2 buckets"):
        SessionTable(spark, str(tmp_path / "t"), 3).current()


def test_files_stay_bounded(spark, tmp_path):
    table = SessionTable(spark, str(tmp_path / "t"), 2)
    for k in range(12):
        table.apply(_session(spark, **{str(j): str(k) for j in range(k % 3, 12)}), "s", k)
    assert _texts(table) == {str(j): str(11 if j > 1 else 10 if j else 9) for j in range(12)}
    files = lambda part: len(list((tmp_path / "t" / part).rglob("*.parquet")))
    assert files("data") <= 2 * FILES * SLOTS and files("manifest") == SLOTS
