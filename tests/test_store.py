"""Snapshots, the JSON document, and maintenance by events."""

import json

import pytest

from loomgraph.operators.index import build
from loomgraph.sources.store import LoadFailed, Store, export_document, import_document, repo_id_of
from loomgraph.streaming.maintain import EVENTS, Maintainer

A = "export function target() {}\n"
B = "export const user = () => { target(); gone(); };\n"


def _files(spark, files):
    return spark.createDataFrame(sorted(files.items()), "file string, content string")


def _edges(graph):
    return sorted((r.from_id, r.to_name, r.to_id, r.ambiguous, r.candidate_count) for r in graph.edges.collect())


def _symbols(graph):
    return sorted((r.id, r.kind, r.signature) for r in graph.symbols.collect())


def test_snapshot_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with pytest.raises(LoadFailed) as why:
        store.load("/r")
    assert why.value.reason == "missing"
    graph = build(_files(spark, {"a.ts": A, "b.ts": B}))
    store.save(graph, "/r", "a" * 40, "main")
    newer = store.save(graph, "/r")
    (tmp_path / repo_id_of("/r") / "99999999-half-written").mkdir()
    back = store.load("/r")
    assert store.current("/r") == newer == back.snapshot and _edges(back.graph) == _edges(graph) and back.meta["edge_count"] == 2
    assert [(r.root_path, r.symbol_count) for r in store.catalog().collect()] == [("/r", 2)]


def test_document_round_trip_and_reasons(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save(build(_files(spark, {"a.ts": A, "b.ts": B})), "/r")
    path = str(tmp_path / "graph.json")
    export_document(store.load("/r"), path, pretty=True)
    back = import_document(spark, path, "/r")
    assert _edges(back.graph) == _edges(store.load("/r").graph) and back.meta["symbol_count"] == 2
    doc = json.load(open(path))
    doc["edges"].append({k: v for k, v in doc["edges"][0].items() if k != "toId"})
    doc["edges"].append(doc["edges"][0] | {"toId": ""})
    doc["symbols"].append(doc["symbols"][0] | {"kind": "odd"})
    doc["symbols"].append("text")
    doc["edgeCount"] = 77
    json.dump(doc, open(path, "w"))
    again = import_document(spark, path)
    assert (again.meta["symbol_count"], again.meta["edge_count"]) == (2, 2)

    def reason(text, root=None):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(LoadFailed) as why:
            import_document(spark, str(tmp_path / "bad.json"), root)
        return why.value.reason

    assert [reason("{"), reason("[]"), reason(json.dumps(doc | {"version": 2})), reason(json.dumps(doc | {"edges": {}})), reason(json.dumps(doc), "/other")] == ["invalid-json", "schema-invalid", "schema-invalid", "schema-invalid", "root-mismatch"]


def test_events_give_what_a_new_index_gives(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    keeper = Maintainer(spark, store, "/r")
    steps = [
        [(1, "b.ts", "add", B), (2, "x.txt", "add", "f()"), (3, "node_modules/y.ts", "add", A)],
        [(4, "a.ts", "add", "old();"), (5, "a.ts", "change", A)],
        [(6, "c.ts", "add", "function target() {}\n")],
        [(7, "a.ts", "change", "export function renamed() {}\n"), (8, "none.ts", "unlink", None)],
        [(9, "b.ts", "unlink", None)],
    ]
    files = {}
    for step in steps:
        keeper.apply(spark.createDataFrame(step, EVENTS))
        for _, path, kind, content in step:
            if path in ("x.txt", "node_modules/y.ts"):
                continue
            files.pop(path, None)
            if kind != "unlink":
                files[path] = content
        now, fresh = store.load("/r").graph, build(_files(spark, files))
        assert _edges(now) == _edges(fresh) and _symbols(now) == _symbols(fresh)
    assert str(keeper.updates[0]) == "1 (+1) symbols, 2 (+2) edges"


def test_stream(spark, tmp_path):
    source = tmp_path / "events"
    source.mkdir()
    (source / "1.json").write_text(json.dumps({"event_seq": 1, "path": "a.ts", "kind": "add", "content": A}))
    store = Store(spark, str(tmp_path / "s"))
    keeper = Maintainer(spark, store, "/r")
    keeper.start(spark.readStream.schema(EVENTS).json(str(source)), str(tmp_path / "cp"), availableNow=True).awaitTermination(60)
    assert store.load("/r").meta["symbol_count"] == 1


def _events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENTS)


def test_batches_without_effect_store_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    keeper = Maintainer(spark, store, "/r")
    first = keeper.apply(_events(spark, (1, "a.ts", "add", A)))
    idle = keeper.apply(_events(spark, (2, "gone.ts", "unlink", None), (3, "x.txt", "add", "f()")))
    assert idle.snapshot is None and (idle.symbols, idle.symbol_delta) == (1, 0) and store.current("/r") == first.snapshot
    assert len(keeper.updates) == 1 and keeper.apply(_events(spark)).snapshot is None


def test_absolute_events_stay_below_the_root(spark, tmp_path):
    keeper = Maintainer(spark, Store(spark, str(tmp_path / "s")), "/r", absolute=True)
    keeper.apply(_events(spark, (1, "/r/a.ts", "add", A), (2, "/other/b.ts", "add", A), (3, "/r/../etc/c.ts", "add", A), (4, "/rx/d.ts", "add", A), (5, "e.ts", "add", A)))
    assert [r.file for r in keeper.store.load("/r").graph.symbols.collect()] == ["a.ts"]


def test_watcher_indexes_first_and_survives_a_failure(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.ts").write_text(A)
    source = tmp_path / "events"
    source.mkdir()
    store = Store(spark, str(tmp_path / "s"))
    keeper = Maintainer(spark, store, str(root), absolute=True)
    apply, calls = keeper.apply, []

    def fails_once(df, n=0):
        calls.append(n)
        if len(calls) == 1:
            raise OSError("full")
        return apply(df, n)

    monkeypatch.setattr(keeper, "apply", fails_once)
    for n, kind in enumerate(("add", "change"), 1):
        (source / f"{n}.json").write_text(json.dumps({"event_seq": n, "path": f"{root}/b.ts", "kind": kind, "content": B}))
        keeper.start(spark.readStream.schema(EVENTS).json(str(source)), str(tmp_path / "cp"), availableNow=True).awaitTermination(60)
    assert [str(u) for u in keeper.updates] == ["1 (+1) symbols, 0 edges", "2 (+1) symbols, 2 (+2) edges"]
    assert len(keeper.failures) == 1 and keeper.failures[0][1] == "OSError: full"
    (root / "c.ts").write_text(A)
    assert keeper.full_reindex().symbols == 2
    assert store.load_or_none("/none") is None and store.load_or_none(str(root)).meta["symbol_count"] == 2
    assert (tmp_path / "s" / repo_id_of(str(root))).stat().st_mode & 0o777 == 0o700


def test_damaged_snapshots_are_passed_over(spark, tmp_path):
    from loomgraph.operators.index import build
    from loomgraph.sources.store import LoadFailed, Store, repo_id_of

    store = Store(spark, str(tmp_path))
    graph = build(spark.createDataFrame([("a.ts", "function f() {}")], "file string, content string"))
    good = store.save(graph, "/r/a")
    broken = store.save(graph, "/r/a")
    store.save(graph, "/r/b")
    places = {root: tmp_path / repo_id_of(root) for root in ("/r/a", "/r/b")}

    def damage(path, text):
        path.write_text(text)
        crc = path.parent / ".meta.json.crc"
        if crc.exists():
            crc.unlink()

    damage(places["/r/a"] / broken / "meta.json", "{not json")
    assert store.current("/r/a") == good and store.load("/r/a").snapshot == good
    (only,) = places["/r/b"].iterdir()
    for text, reason in (("{not json", "invalid-json"), ("[]", "schema-invalid"), ('{"version": 1}', "schema-invalid")):
        damage(only / "meta.json", text)
        assert [r.root_path for r in store.catalog().collect()] == ["/r/a"]
        with pytest.raises(LoadFailed) as why:
            store.load("/r/b")
        assert why.value.reason == reason
    from loomgraph.service import Workspace

    assert not Workspace(spark, str(tmp_path)).request("recall", {"query": "f", "path": "/r/a"}).is_error


def _rows(df):
    return sorted(map(repr, df.drop("seq").collect()))


def _numbered(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], EVENTS)


def test_changes_write_changed_partitions_only(spark, tmp_path, monkeypatch):
    from loomgraph.sources import store as stored

    monkeypatch.setattr(stored, "FILES_A_BUCKET", 4)
    files = {f"src/m{k}.ts": f"export function f{k}() {{ f{(k + 1) % 200}(); shared(); }}\n" for k in range(200)}
    store = Store(spark, str(tmp_path))
    built = build(spark.createDataFrame(list(files.items()), "file string, content string"))
    first = store.save(built, "/r")
    keeper = Maintainer(spark, store, "/r")
    steps = [
        [("src/m7.ts", "change", "export function g7() { f8(); }\n")],  # another file's call now leads nowhere
        [("src/new.ts", "add", "export function shared() {}\nexport function f7() {}\n")],  # calls of all files find a target
        [("src/m9.ts", "unlink", None), ("src/none.ts", "unlink", None)],
        [("src/zz.ts", "add", "export function shared() {}\n")],  # all of them become ambiguous
    ]
    old = _rows(store.load("/r").graph.edges)
    for step in steps:
        update = keeper.apply(_numbered(spark, *step))
        for path, kind, content in step:
            files.pop(path, None) if kind == "unlink" else files.__setitem__(path, content)
        want = build(spark.createDataFrame(list(files.items()), "file string, content string"))
        now = store.load("/r")
        assert _rows(now.graph.symbols) == _rows(want.symbols) and _rows(now.graph.edges) == _rows(want.edges)
        assert (update.symbols, update.edges) == (want.symbols.count(), want.edges.count()) == (now.meta["symbol_count"], now.meta["edge_count"])
        assert now.meta["files_indexed"] == len(files)
    one = store._meta(repo_id_of("/r"), store._names(repo_id_of("/r"))[1])
    wrote = {t: [len(b) for n, b in one["parts"][t].items() if n != first] for t in ("symbols", "edges")}
    assert one["buckets"] == 50 and wrote["symbols"] == [1] and wrote["edges"][0] <= 2  # m7's partition, and that of its caller m6
    size = spark.read.parquet(f"{tmp_path}/{repo_id_of('/r')}/{store._names(repo_id_of('/r'))[1]}/edges").count()
    assert size < 0.1 * built.edges.count()
    assert keeper.apply(_numbered(spark, ("src/m3.ts", "change", files["src/m3.ts"]))).snapshot is None  # the same content again
    assert sorted(_rows(built.edges)) == old  # and the first snapshot reads as before
    gone = store.prune("/r", 1)
    assert first not in gone or first not in str(store.load("/r").meta["parts"])
    assert _rows(store.load("/r").graph.edges) == _rows(want.edges)


def test_many_folders_are_written_anew(spark, tmp_path, monkeypatch):
    from loomgraph.sources import store as stored

    monkeypatch.setattr(stored, "FILES_A_BUCKET", 1)
    monkeypatch.setattr(stored, "MAX_FOLDERS", 2)
    files = {f"m{k}.ts": f"function f{k}() {{}}" for k in range(6)}
    store = Store(spark, str(tmp_path))
    store.save(build(spark.createDataFrame(list(files.items()), "file string, content string")), "/r")
    keeper = Maintainer(spark, store, "/r")
    for k in range(4):
        keeper.apply(_numbered(spark, (f"m{k}.ts", "change", f"function g{k}() {{ f5(); }}")))
        assert len(store.load("/r").meta["parts"]["symbols"]) <= 2
    now = store.load("/r").graph
    assert {r.name for r in now.symbols.collect()} == {"g0", "g1", "g2", "g3", "f4", "f5"} and now.edges.filter("to_id = 'm5.ts#f5@1'").count() == 4
    names = store._names(repo_id_of("/r"))
    assert len(store.prune("/r", 1)) >= 1 and len(store._names(repo_id_of("/r"))) < len(names)
    assert {r.name for r in store.load("/r").graph.symbols.collect()} == {"g0", "g1", "g2", "g3", "f4", "f5"}


def test_a_failed_batch_is_tried_once_more(spark, tmp_path, monkeypatch):
    from loomgraph.streaming import maintain

    store = Store(spark, str(tmp_path))
    store.save(build(spark.createDataFrame([("a.ts", "function a() {}")], "file string, content string")), "/r")
    keeper = Maintainer(spark, store, "/r")
    with monkeypatch.context() as m:
        m.setattr(maintain, "store_changes", lambda *_: 1 / 0)
        keeper._batch(_numbered(spark, ("b.ts", "add", "function b() {}"), ("c.ts", "add", "function old() {}")), 1)
    assert [n for n, _ in keeper.failures] == [1]
    keeper._batch(_numbered(spark, ("c.ts", "add", "function c() {}")), 2)
    assert {r.name for r in store.load("/r").graph.symbols.collect()} == {"a", "b", "c"} and len(keeper.failures) == 1 and keeper._pending is None
