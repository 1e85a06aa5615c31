import json

import pytest
from pyspark.sql import functions as F

from sediment.sources.records import inventory, json_rows, record_files, record_lines, session_events
from sediment.sources.sinks import write_json_table, write_nodes
from sediment.plans import fixtures


@pytest.fixture()
def folder(tmp_path):
    rows = [
        {"type": "session_meta", "payload": {"cwd": "/x"}},
        {"type": "response_item", "payload": {"role": "user", "content": [{"text": "hello"}, {"text": "there"}]}},
        {"role": "assistant", "content": "an answer", "phase": "commentary"},
        {"role": "assistant", "content": "an answer"},
        {"type": "x", "payload": {"type": "function_call", "name": "run", "arguments": "{\"cmd\": \"ls -l\"}"}},
        {"type": "x", "payload": {"type": "function_call_output", "output": "done"}},
        {"role": "human", "text": "again"},
        {"role": "tool", "content": "noted"},
        {"role": "Assistant", "payload": {"content": [{"content": [{"text": "deep"}]}, "flat"]}},
        {"content": "no role"},
        {"payload": {"type": "function_call", "arguments": "plain words"}},
        {"payload": {"type": "function_call_output", "output": "Chunk ID: 1\nWall time: 2\nOutput:\nall well"}},
    ]
    text = "\n".join(json.dumps(r) for r in rows) + "\r\n\nnot json\n[1]\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s.jsonl").write_bytes(text.encode() + b"\xff\xfe")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.md").write_text("skipped")
    (tmp_path / "b.bin").write_text("skipped")
    return str(tmp_path)


def test_files_lines_and_events(spark, folder):
    files = record_files(spark, folder)
    assert files.count() == 1
    assert inventory(files).first()["length"] > 0
    lines = record_lines(files)
    assert [r["line_number"] for r in lines.orderBy("line_number").collect()] == list(range(1, 17))
    good = json_rows(lines, "role string")
    assert good.count() == 12
    with pytest.raises(Exception, match="not a JSON object"):
        json_rows(lines, "role string", strict=True).collect()
    got = [(r["line_number"], r["kind"], r["text"]) for r in session_events(good).orderBy("line_number").collect()]
    assert got == [(2, "user", "hello\nthere"), (4, "assistant", "an answer"), (5, "command", "run: ls -l"), (6, "command_output", "done"), (7, "user", "again"), (8, "record", "noted"), (9, "assistant", "deep\nflat"), (10, "record", "no role"), (11, "command", "tool: plain words"), (12, "command_output", "all well")]


def test_sinks(spark, tmp_path):
    nodes = fixtures.nodes(spark, "/root/testdata/sf0.001")
    write_nodes(nodes, str(tmp_path / "nodes"))
    back = spark.read.parquet(str(tmp_path / "nodes"))
    assert back.count() == nodes.count() > len(fixtures.NODES)
    assert back.filter("node_file = 'explicit'").count() == nodes.filter("source = 'explicit'").count() > 2
    write_json_table(spark.range(3), str(tmp_path / "j"))
    with pytest.raises(Exception):
        write_json_table(spark.range(3), str(tmp_path / "j"), overwrite=False)
    assert spark.read.json(str(tmp_path / "j")).agg(F.sum("id")).first()[0] == 3
