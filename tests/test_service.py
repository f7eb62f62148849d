"""Requests, their validation, and the log."""

import json
import os

import pytest

from loomgraph import journal
from loomgraph.requests import BadRequest, validate
from loomgraph.service import Workspace, root_from_uri


@pytest.mark.parametrize(
    ("tool", "arguments"),
    [("recall", {}), ("recall", {"query": " "}), ("recall", {"query": "x" * 201}), ("recall", {"query": "x", "limit": 51}), ("recall", {"query": "x", "limit": 1.5}), ("recall", {"query": "x", "limit": True}), ("recall", {"query": "x", "substring": 1}), ("recall", {"query": "x", "more": 1}), ("callers", {"symbol": "s", "direction": "up"}), ("impact", {"symbol": "s", "depth": 6}), ("impact", {"symbol": "s", "since": ""}), ("index", {"path": "p" * 1025}), ("index", [1]), ("other", {})],
)
def test_bad_requests(tool, arguments):
    with pytest.raises(BadRequest):
        validate(tool, arguments)


def test_good_requests():
    assert validate("recall", {"query": "x", "limit": 50.0, "path": None}) == {"query": "x", "limit": 50}
    assert validate("index", None) == {}
    assert root_from_uri("file:///a%20b") == "/a b" and root_from_uri("/x") == "/x" and root_from_uri("x") is None


def test_journal(tmp_path, monkeypatch):
    path = str(tmp_path / "log" / "r.jsonl")
    journal.append(path, "recall", {"query": "a\x00b" + "c" * 600, "n": 1, "deep": {"x": 1}, "k" * 100: 1}, 2, 3.4, "bad\n")
    entry = json.loads(open(path).read())
    assert entry["input"] == {"query": ("a b" + "c" * 600)[:500], "n": 1, "deep": "[unloggable]"} and entry["error"] == "bad " and entry["durationMs"] == 3
    assert os.stat(path).st_mode & 0o777 == 0o600
    monkeypatch.setattr(journal, "MAX_BYTES", 10)
    journal.append(path, "recall", None, 0, 0)
    assert os.path.exists(path + ".1") and len(open(path).readlines()) == 1
    monkeypatch.setenv(journal.OFF, "1")
    journal.append(path, "recall", None, 0, 0)
    assert len(open(path).readlines()) == 1


def test_workspace(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.ts").write_text("export function target() {}\nexport function top() { middle(); }\n")
    (root / "b.test.ts").write_text("function middle() { target(); other(); }\n")
    space = Workspace(spark, str(tmp_path / "store"), str(tmp_path / "log.jsonl"))
    assert space.request("recall", {"query": "x", "path": str(root)}).is_error
    assert space.request("index", {"path": str(root)}).text.startswith("2 files (0 failed), 3 symbols, 3 calls, 2 resolved")
    assert [r.name for r in space.request("recall", {"query": "TARGET", "path": str(root)}).rows] == ["target"]
    assert not space.request("recall", {"query": "nothing"}).is_error
    assert space.request("callers", {"symbol": "target"}).text == "middle -> target  b.test.ts:1"
    assert len(space.request("callers", {"symbol": "middle", "direction": "callees"}).rows) == 2
    assert len(space.request("callers", {"symbol": "middle", "direction": "callees", "include_unresolved": False}).rows) == 1
    assert space.request("callers", {"symbol": "a.ts#none@1"}).is_error
    found = space.request("impact", {"symbol": "a.ts#target@1", "depth": 2})
    assert [(r.caller_id, r.depth, r.is_test) for r in found.rows] == [("b.test.ts#middle@1", 1, True), ("a.ts#top@2", 2, False)]
    assert space.request("impact", {"symbol": "target", "since": "HEAD"}).is_error
    assert space.request("index", {"path": "/etc"}).is_error
    (root / "c.ts").write_text("target();\n")
    space.request("index", {"path": str(root)})
    assert len(space.request("callers", {"symbol": "target"}).rows) == 2
    assert space.status().text.endswith("Z") or "3 files" in space.status().text
    assert len(open(tmp_path / "log.jsonl").readlines()) == 13


def test_impact_text_names_ends_tests_and_public_callers(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.ts").write_text("export function target() {}\nexport function top() { middle(); }\nfunction middle() { target(); }\n")
    (root / "a.test.ts").write_text("function check() { top(); }\n")
    space = Workspace(spark, str(tmp_path / "store"))
    space.request("index", {"path": str(root)})
    lines = space.request("impact", {"symbol": "target"}).text.split("\n")
    assert lines[1:] == ["exported: changes reach beyond the callers below", "  middle via target  a.ts", "    top via middle  a.ts", "      check via top  a.test.ts (test)", "tests to run: a.test.ts", "public API reached: top"]


def test_which_repository(spark, tmp_path, monkeypatch):
    roots = [tmp_path / "one", tmp_path / "two"]
    space = Workspace(spark, str(tmp_path / "store"))
    for root in roots:
        (root / "deep").mkdir(parents=True)
        (root / "a.ts").write_text("function f() {}\n")
        space.request("index", {"path": str(root)})
    one, two = map(str, roots)
    monkeypatch.chdir(roots[0] / "deep")
    assert space.repository(None) == one
    monkeypatch.setenv("LOOMGRAPH_ROOT", two)
    assert space.repository(None) == two and space.repository(one) == one
    monkeypatch.delenv("LOOMGRAPH_ROOT")
    monkeypatch.chdir(tmp_path)
    assert space.request("recall", {"query": "f"}).is_error
    (roots[0] / ".git").mkdir()
    assert space.repository(f"{one}/deep") == one
    monkeypatch.setenv("LOOMGRAPH_NO_WORKTREE", "1")
    assert space.repository(f"{one}/deep") == f"{one}/deep"


def test_command_line_checks(capsys):
    from loomgraph.__main__ import main

    assert main(["version"]) == 0 and capsys.readouterr().out.strip()
    for bad in (["watch", "."], ["unknown"]):
        with pytest.raises(SystemExit) as why:
            main(bad)
        assert why.value.code == 2


def test_the_stored_root_around_the_current_folder_is_meant(spark, tmp_path, monkeypatch):
    from loomgraph.operators.index import build
    from loomgraph.service import NotFound, Workspace

    space = Workspace(spark, str(tmp_path / "store"))
    graph = build(spark.createDataFrame([("a.ts", "function f() {}")], "file string, content string"))
    here = tmp_path / "Work" / "app"
    here.mkdir(parents=True)
    monkeypatch.chdir(here)
    monkeypatch.delenv("LOOMGRAPH_ROOT", raising=False)
    space.store.save(graph, str(here / "below"))
    space.store.save(graph, "/elsewhere")
    with pytest.raises(NotFound, match="several"):
        space.repository(None)
    around = str(tmp_path / "WORK")  # the same folder but for case
    space.store.save(graph, around)
    assert space.repository(None) == around


def test_lookups_do_not_move_the_calls(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomgraph.operators.impact import calls_into
    from loomgraph.operators.index import build

    rows = [("lib.ts", "export function hot() {}\nexport function cold() { hot(); }\n")] + [(f"m{k}.ts", f"function f{k}() {{ {'hot(); ' * 6}cold(); nowhere(); }}") for k in range(120)]
    space = Workspace(spark, str(tmp_path))
    space.store.save(build(spark.createDataFrame(rows, "file string, content string")), "/r")
    held = space.graph("/r")
    assert held.incoming.filter("to_id IS NULL").isEmpty() and held.incoming.filter("to_name = 'hot'").count() == 500
    ids = spark.createDataFrame([("lib.ts#cold@2",)], "id string")
    plan = calls_into(held.incoming, ids)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(to_id" in line and "from_id" in line]
    assert not moved and "InMemoryTableScan" in plan, plan
    assert calls_into(held.incoming, ids).count() == 120
    answer = space.request("impact", {"symbol": "hot", "depth": 2, "path": "/r"})
    assert not answer.is_error and "only the first 500" in answer.text
    want = build(spark.createDataFrame(rows, "file string, content string")).edges
    assert sorted(r.from_id for r in space.request("callers", {"symbol": "hot", "limit": 100, "path": "/r"}).rows) == sorted(r.from_id for r in want.filter("to_name = 'hot'").orderBy("seq").limit(100).collect())
