"""The reader of source texts, the scan of folders, and git provenance."""

import subprocess

import pytest

from loomgraph.sources.git import changed_files, read_head
from loomgraph.sources.scan import MAX_BYTES, RootRefused, guard_root, is_under, list_sources
from loomgraph.sources.structure import list_functions, read_source


def ids(source, path="a.ts"):
    return [(s["id"], s["kind"]) for s in read_source(source, path)[0]]


def calls(source, path="a.ts"):
    return [(c["from_id"].split("#")[1], c["to_name"]) for c in read_source(source, path)[1]]


def test_kinds():
    src = "export class A extends B<string> implements I, J.K {\n  static make() {}\n  get size() { return 1 }\n  set size(v) {}\n  run() {}\n}\ninterface S { f(): void }\ntype T = string;\nenum E { X }\nnamespace N { export function dist() {} }\nconst cb: () => void = noop;\nconst o = { m() {}, k: () => 1 };\nexport default function () {}\n"
    assert ids(src) == [("a.ts#A@1", "class"), ("a.ts#A.make@2", "method"), ("a.ts#A.size@3", "getter"), ("a.ts#A.size@4", "setter"), ("a.ts#A.run@5", "method"), ("a.ts#S@7", "interface"), ("a.ts#T@8", "type"), ("a.ts#E@9", "enum"), ("a.ts#N.dist@10", "function"), ("a.ts#cb@11", "variable"), ("a.ts#o.m@12", "method"), ("a.ts#o.k@12", "variable"), ("a.ts#default@13", "function")]
    first = read_source(src, "a.ts")[0]
    assert first[0]["extends"] == ["B"] and first[0]["implements"] == ["I", "J.K"]
    assert [s["name"] for s in first if s["exported"]] == ["A", "make", "size", "size", "run", "dist", "default"]
    assert [s["name"] for s in first if s["is_static"]] == ["make"]
    assert list_functions(src, "a.ts")[0] == "make"


def test_call_owners():
    src = "function outer(a = dflt()) { const inner = () => { one() }; inner(); xs.forEach(() => two()); }\ntop(); if (a) { cond() }\nconst o = { k: () => halt() };\n"
    assert calls(src) == [("outer@1", "inner"), ("outer@1", "forEach"), ("outer@1", "two"), ("inner@1", "one"), ("<module>", "top"), ("<module>", "cond"), ("<module>", "halt")]


def test_calls_without_a_name_do_not_count():
    assert calls("(x)(); a[0](); super(); import('x'); f()();\n") == [("<module>", "f")]


def test_chained_new_and_generic_calls():
    assert calls("a.b().c(); new Map<string, number>(); new ns.K(); foo<T>(1); x?.y?.();\n") == [("<module>", n) for n in ("c", "b", "Map", "K", "foo", "y")]


def test_jsx():
    src = 'const App = () => <Layout on={() => go()}><div className="x">it\'s {xs.map(i => <Item.Row k={i} />)}</div></Layout>;\nfunction f() { done(); }\n'
    assert calls(src, "a.tsx") == [("App@1", "Layout"), ("App@1", "go"), ("App@1", "map"), ("App@1", "Row"), ("f@2", "done")]


def test_texts_hide_code():
    assert calls("// a()\n/* b() */ const s = 'c()' + `d() ${e()}`; const r = /f(g)\"/.test(s);\n") == [("<module>", "e"), ("<module>", "test")]


@pytest.mark.parametrize("src", ["", "{{{", "))", "function (", "class {", "const", "`${", "<a", "export", "type X =", "a = /", "interface", "new", "'", "class A { [x", "\x00é"])
def test_broken_code_never_raises(src):
    for path in ("a.ts", "a.tsx"):
        read_source(src, path)


def test_scan(tmp_path):
    root, other = tmp_path / "repo", tmp_path / "repo-2"
    for p in ("src/a.ts", "src/b.test.tsx", "node_modules/x.ts", "src/t.d.ts", ".hid/c.ts", "d.txt"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("f();")
    other.mkdir()
    (other / "z.ts").write_text("x")
    (root / "link.ts").symlink_to(other / "z.ts")
    (root / "dir").symlink_to(other)
    (root / "big.ts").write_bytes(b" " * (MAX_BYTES + 1))
    assert list_sources(str(root)) == ([("src/a.ts", 4), ("src/b.test.tsx", 4)], 1)
    assert is_under("/A/b", "/a") and not is_under("/ab", "/a")
    for bad in ("/", "/etc", str(tmp_path / "none")):
        with pytest.raises(RootRefused):
            guard_root(bad)


def test_index_directory_and_git(spark, tmp_path):
    from loomgraph.operators.index import index_directory

    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    (tmp_path / "a.ts").write_text("export function target() {}\nexport function dup() {}\n")
    (tmp_path / "b.ts").write_text("function dup() {}\nexport const user = () => { target(); dup(); gone(); };\n")
    git("init", "-b", "main")
    git("add", "-A")
    git("commit", "-m", "one")
    (tmp_path / "b.ts").write_text((tmp_path / "b.ts").read_text() + "user();\n")
    (tmp_path / "c.ts").write_text("")
    git("add", "-A")
    git("commit", "-m", "two")
    assert read_head(str(tmp_path))["branch"] == "main" and len(read_head(str(tmp_path))["sha"]) == 40
    assert sorted(tuple(r) for r in changed_files(spark, str(tmp_path), "HEAD~1").collect()) == [("b.ts", "modified"), ("c.ts", "added")]
    assert changed_files(spark, str(tmp_path), "no-such-ref") is None
    graph = index_directory(spark, str(tmp_path))
    assert (graph.files_indexed, graph.files_failed) == (3, 0)
    found = sorted((r.from_id, r.to_name, r.to_id, r.ambiguous, r.candidate_count) for r in graph.edges.collect())
    assert found == [("b.ts#<module>", "user", "b.ts#user@2", None, None), ("b.ts#user@2", "dup", "b.ts#dup@1", True, 2), ("b.ts#user@2", "gone", None, None, None), ("b.ts#user@2", "target", "a.ts#target@1", None, None)]


def test_long_type_arguments_are_read_whole():
    many = ", ".join(f"T{k}" for k in range(300))
    symbols, calls = read_source(f"const z: Foo<{many}> = () => {{ call<{many}>(1); }};", "a.ts")
    assert ("z", "variable") in {(s["name"], s["kind"]) for s in symbols} and [(c["to_name"], c["from_id"]) for c in calls] == [("call", "a.ts#z@1")]


def test_many_open_angles_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.perf_counter()
        read_source("a < b;\n" * n + "x = " + "a < " * n + "b;\nf();\n", "a.ts")
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1


def test_many_nested_types_are_no_calls():
    inner = "".join(f"  a{k}: {{ b(x: number): C{k}; }};\n" for k in range(40))
    symbols, calls = read_source(f"type T = {{\n{inner}  m(): void;\n}};\nfunction f() {{ g(); }}\n", "a.ts")
    assert [c["to_name"] for c in calls] == ["g"] and [s["name"] for s in symbols] == ["T", "f"]


def test_a_folder_that_may_not_be_read_has_no_git(tmp_path, monkeypatch):
    import os

    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "HEAD").write_text("a" * 40 + "\n")
    (tmp_path / "shut" / "code").mkdir(parents=True)
    real = os.stat

    def stat(path, *args, **more):
        if "shut" in os.fspath(path):
            raise PermissionError(13, "Permission denied", path)
        return real(path, *args, **more)

    monkeypatch.setattr(os, "stat", stat)
    assert read_head(str(tmp_path / "shut" / "code"))["sha"] == "a" * 40
    (tmp_path / ".git" / "HEAD").unlink()
    assert read_head(str(tmp_path / "shut" / "code"))["sha"] is None


def test_reading_is_dealt_to_all_cores_and_loses_no_file(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators.index import BATCH_FILES, extract

    n = 3 * BATCH_FILES + 7
    files = spark.range(0, n, 1, 1).select(F.concat(F.lit("f"), "id", F.lit(".ts")).alias("file"), F.when(F.col("id") == 5, None).otherwise(F.concat(F.lit("function g"), "id", F.lit("() { h(); }"))).alias("content"))
    rows = extract(files).withColumn("part", F.spark_partition_id()).cache()
    assert rows.select("part").distinct().count() > 1
    got = {r.file: [s.name for s in r.symbols] for r in rows.collect()}
    assert got == {f"f{k}.ts": [f"g{k}"] if k != 5 else [] for k in range(n)}
    assert [r.file for r in rows.filter("error IS NOT NULL").collect()] == ["f5.ts"]
    whole = {r.file: len(r.calls) for r in extract(files, spread=False).collect()}
    assert whole == {r.file: len(r.calls) for r in rows.collect()} and len(whole) == n
