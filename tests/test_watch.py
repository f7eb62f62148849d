"""The folder source: events between listings, settling, restarts, and a graph kept by watching."""

import os
import time

from loomgraph.operators.index import build
from loomgraph.sources.store import Store
from loomgraph.streaming.maintain import Maintainer
from loomgraph.streaming.watch import _Listing, between, folder_events


def _write(path, text, age=10.0):
    path.write_text(text)
    then = time.time() - age
    os.utime(path, (then, then))


def test_events_are_told_once_and_again_after_a_restart(tmp_path):
    reader = _Listing(str(tmp_path), 0.3)
    _write(tmp_path / "a.ts", "function a() {}", 20)
    _write(tmp_path / "b.ts", "function b() {}", 20)
    _write(tmp_path / "c.txt", "no source", 20)
    start = reader.initialOffset()
    rows, first = reader.read(start)
    rows = list(rows)
    assert rows == [(1, f"{tmp_path}/a.ts", "add"), (2, f"{tmp_path}/b.ts", "add")] == list(reader.readBetweenOffsets(start, first))
    again, same = reader.read(first)
    assert list(again) == [] and same == first
    _write(tmp_path / "a.ts", "function a2() {}", 10)
    (tmp_path / "b.ts").unlink()
    _write(tmp_path / "d.ts", "", 0)  # still being written
    rows, second = reader.read(first)
    assert list(rows) == [(3, f"{tmp_path}/a.ts", "change"), (4, f"{tmp_path}/b.ts", "unlink")]
    _write(tmp_path / "d.ts", "function d() {}", 5)
    rows, third = reader.read(second)
    assert list(rows) == [(5, f"{tmp_path}/d.ts", "add")] and between(first, third) == [(3, f"{tmp_path}/a.ts", "change"), (4, f"{tmp_path}/b.ts", "unlink"), (5, f"{tmp_path}/d.ts", "add")]


def test_a_file_that_is_being_written_keeps_its_last_state(tmp_path):
    reader = _Listing(str(tmp_path), 60)
    _write(tmp_path / "a.ts", "old", 100)
    _, first = reader.read(reader.initialOffset())
    _write(tmp_path / "a.ts", "new text", 1)
    rows, second = reader.read(first)
    assert list(rows) == [] and second == first


def test_a_watched_folder_equals_one_indexed_anew(spark, tmp_path):
    root, files = tmp_path / "work", {}

    def put(name, text):
        files[name] = text
        _write(root / name, text, 10 - len(files) / 10)

    root.mkdir()
    put("a.ts", "export function a() { b(); }\n")
    store = Store(spark, str(tmp_path / "store"))
    keeper = Maintainer(spark, store, str(root), absolute=True)

    def run():
        keeper.start(folder_events(spark, str(root)), str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
        assert keeper.failures == []
        want = build(spark.createDataFrame(list(files.items()), "file string, content string"))
        now = store.load(str(root)).graph
        for have, should in ((now.symbols, want.symbols), (now.edges, want.edges)):
            assert sorted(map(repr, have.select(*should.columns).collect())) == sorted(map(repr, should.collect()))

    run()
    put("b.ts", "export function b() {}\n")
    put("a.ts", "export function a() { b(); c(); }\n")
    run()
    (root / "b.ts").unlink()
    del files["b.ts"]
    run()
    before = store.current(str(root))
    run()
    assert store.current(str(root)) == before
