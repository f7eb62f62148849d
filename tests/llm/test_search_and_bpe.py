"""Ranked search against a scan of all documents, and the encoder against the tokenizers library."""

import hashlib
import math
import random
import re
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import bpe, queries, ranked_search

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " \n\t ", "word", "same text twice", "same text twice", "long " * 30_000, "É\x00ü 😀 <|endoftext|>"]


def _docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([("x", i, t, -1, -2) for i, t in zip(ids, texts, strict=True)], "item_id string, doc_id long, text string, rank long, ids long")


def _items(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(range(len(texts)) if ids is None else ids, texts, strict=True)), "item_id long, text string")


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _scan(docs, items, k):
    """Rows of search by scoring every document (id, text) for every item (id, text)."""
    held = [(i, _terms(t)) for i, t in docs]
    some = [(i, w) for i, w in held if w]
    n_docs, n_terms = len(some), sum(len(w) for _, w in some)
    df = {}
    for _, w in some:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item in sorted({i for i, _ in items}):
        asked = {t for i, text in items if i == item for t in _terms(text)}
        rated = []
        for i, w in some:
            m = 10 + 90 * len(w) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in asked if t in df)
            if score > 0:
                rated.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(rated)[:k], 1)]
    return out


def _found(spark, docs, items, k=10):
    df = ranked_search.search(_docs(spark, [t for _, t in docs], [i for i, _ in docs]), _items(spark, [t for _, t in items], [i for i, _ in items]), k)
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_search_equals_a_scan_with_ties_and_repeated_rows(spark, monkeypatch):
    rng = random.Random(5)
    words = [*"abcdefgh", "É", "éa", "X9", "hapax"]
    docs = [(i, " ".join(rng.choices(words, [9, 8, 7, 6, 5, 4, 3, 2, 1, 1, 1, 0.1], k=rng.randrange(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(2000, None), (2001, "!!!"), (7, docs[7][1])]
    items = [(1, "a b c"), (2, "hapax, É!"), (3, None), (4, "nothing here"), (5, docs[7][1]), (5, "x9"), (6, "A a A")]
    want = _scan(docs, items, 10)
    assert _found(spark, docs, items) == want and {i for i, *_ in want} == {1, 2, 5, 6}
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 16)  # several blocks of items
    assert _found(spark, docs, items) == want
    assert _found(spark, docs, items, 3) == _scan(docs, items, 3)


def test_search_of_small_shards(spark):
    rng = np.random.default_rng(2)
    n, width, k = 700, 12, 10
    counts = (rng.random((n, width)) < 0.3) * rng.integers(1, 6, (n, width))
    index = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(counts.sum(1) + 1), *(pa.array([c[c > 0].tolist() if w else np.flatnonzero(c).tolist() for c in counts], pa.list_(pa.int32())) for w in (0, 1))], ["doc_id", "n", "terms", "counts"])
    weights, terms = np.array([900, 50, 300, 7]), np.array([1, 4, 5, 9])
    none = np.zeros(0, np.int64)
    whole = ranked_search.Shard(index, n, int(counts.sum()) + n, width)
    scores = whole.table[:, terms].astype(np.int64) @ weights
    best = np.lexsort((np.arange(n), -scores))[:k]
    held = none, none
    for at in range(0, n, 64):
        held = ranked_search.Shard(index.slice(at, 64), n, int(counts.sum()) + n, width).best(terms, weights, k, held)[:2]
    for found in (held, whole.best(terms, weights, k, (none, none))[:2]):
        assert found[1].tolist() == best.tolist() and found[0].tolist() == scores[best].tolist()


def test_search_stops_early_and_goes_on_through_ties():
    n = 5000
    rows = pa.array([[0]] * n, pa.list_(pa.int32()))
    counts = pa.array([[9] if i >= n - 20 else [1] for i in range(n)], pa.list_(pa.int32()))
    index = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 10)), rows, counts], ["doc_id", "n", "terms", "counts"])
    shard, none = ranked_search.Shard(index, n, 10 * n, 1), np.zeros(0, np.int64)
    scores, ids, depth = shard.best(np.array([0]), np.array([5]), 10, (none, none))
    assert ids.tolist() == list(range(n - 20, n - 10)) and depth < 100
    tied = ranked_search.Shard(index.slice(0, n - 20), n, 10 * n, 1)
    assert tied.best(np.array([0]), np.array([5]), 10, (none, none))[1].tolist() == list(range(10))


def test_search_of_awkward_and_empty_tables(spark):
    assert _found(spark, [], [(1, "a")]) == [] and _found(spark, [(1, "a b")], []) == [] and _found(spark, [(1, None), (2, "")], [(1, "a")]) == []
    docs = list(enumerate(AWKWARD))
    assert _found(spark, docs, [(1, "word"), (2, "SAME same"), (3, "long ü")]) == _scan(docs, [(1, "word"), (2, "SAME same"), (3, "long ü")], 10)
    rows = ranked_search.search(_docs(spark, ["b a", "a b", "b b"], [None, 4, 5]), _items(spark, ["a"], [None])).collect()
    assert sorted((r.rank, r.doc_id) for r in rows) == [(1, 4), (2, None)] and all(r.item_id is None for r in rows)


def test_search_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.op11_ranked_search(spark, SF)
    assert sorted(map(tuple, df.collect())) == sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ranked_search.ORACLE_SQL})").fetchall())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_TOKENIZER))


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(queries.tokenizer_path(queries.BYTE_TOKENIZER))


PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "<|endoftext|>", "<|endof", "é", "ü", "😀", "1", "23", "!", "...", " ", "　", " ", "\x1c", "\x85", "​", "ab", "the", " the", "中", "\x00", "᠎", "́", "\U00020000"]


def test_encoding_equals_the_library(library, ours):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(5000)]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    found, counts = ours.encode_all(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(found, np.cumsum(counts)[:-1])] == want
    assert ours.decode_all(found.astype(np.int64), counts) == [library.decode(x, skip_special_tokens=False) for x in want] == texts


def test_every_character_falls_into_the_library_s_class(library, ours):
    step = 1 if "--all-characters" in sys.argv else 7
    for c in map(chr, [*range(0, 0x3000), *(c for c in range(0x3000, 0x110000, step) if not 0xD800 <= c < 0xE000)]):
        text = f"a{c}{c}1 {c}!"
        assert (ours.words if c <= "￿" else ours.any_words).findall(text) == ours.any_words.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_long_words_and_one_tree_or_many(library, ours):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (1, 2, 31, 32, 33, 64, 500)] + ["a" * 50_000, "the" * 7000]
    for word in words:
        assert ours.encode(word) == library.encode(word, add_special_tokens=False).ids
    rows = [[ours.byte_ids[b] for b in rng.choices(b"theringaou", k=rng.randrange(1, 17))] for _ in range(2000)]
    merged = ours.merge_many(np.array([r + [-1] * (16 - len(r)) for r in rows]))
    assert [m[m >= 0].tolist() for m in merged] == [ours.merge(list(r)) for r in rows]


def test_the_table_of_known_words_starts_anew(ours, monkeypatch):
    want = ours.encode("one two three <|endoftext|>four")
    monkeypatch.setattr(bpe, "KEPT_WORDS", 2)
    assert ours.encode("one two three <|endoftext|>four") == want and ours.encode("five") and len(ours.known) <= 3


def test_round_trip_of_awkward_and_empty_tables(spark, library):
    path = queries.tokenizer_path(queries.BYTE_TOKENIZER)
    assert bpe.round_trip(_docs(spark, []), path).collect() == []
    for r in bpe.round_trip(_docs(spark, AWKWARD), path).collect():
        ids = library.encode(AWKWARD[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_columns_stay_and_broken_ids_are_told(spark):
    path = queries.tokenizer_path(queries.BYTE_TOKENIZER)
    coded = bpe.encode(_docs(spark, ["a b", None]), path)
    assert coded.columns == ["item_id", "doc_id", "text", "rank", "ids"] and [r.ids for r in coded.orderBy("doc_id").collect()] == [[64, 275], []]
    rows = spark.createDataFrame([(1, [64, 275]), (2, None), (3, [])], "k int, ids array<int>")
    assert [r.text for r in bpe.decode(rows, path).orderBy("k").collect()] == ["a b", "", ""]
    with pytest.raises(Exception, match="an id is not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([50_257],)], "ids array<int>"), path).collect()


def test_files_of_another_kind_are_refused():
    with pytest.raises(ValueError, match="not a plain byte-level BPE file"):
        bpe.Bpe(queries.tokenizer_path())
