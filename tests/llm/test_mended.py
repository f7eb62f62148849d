"""Cases that earlier versions lost or failed on."""

from loomgraph.llm import probminhash, tiff, url_filter


def test_a_file_without_a_directory_gives_an_error_row(spark):
    media = spark.createDataFrame([(1, bytearray(b"II*\0\0\0\0\0")), (2, bytearray(b"MM\0*\0\0\0\0")), (3, bytearray(tiff.encode(bytes(64))))], "k long, media binary")
    rows = {r.k: r for r in tiff.read_pages(media, "k").collect()}
    assert rows[1].error == rows[2].error == "no image directory" and rows[3].error is None and rows[3].height == 1


WORDS = "one two three four five six seven eight nine ten eleven twelve"


def _kept(spark, rows):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, _drop int")
    return sorted(r["_drop"] for r in probminhash.keep_one(docs).collect())


def test_keep_one_goes_by_id_and_text(spark):
    assert _kept(spark, [(1, WORDS), (2, WORDS), (2, "another text that only this row has in it")]) == [0, 2]


def test_keep_one_of_awkward_tables(spark):
    assert _kept(spark, []) == []
    assert _kept(spark, [(None, WORDS), (None, WORDS), (5, None), (4, ""), (6, WORDS), (6, WORDS), (7, WORDS + " thirteen")]) == [0, 1, 3, 4, 5]


def test_keep_one_drops_near_copies(spark):
    text = " ".join(f"w{k}" for k in range(200))
    assert _kept(spark, [(3, text), (9, text + " tail"), (8, "tail of something else entirely, with words of its own")]) == [0, 2]


def test_words_that_begin_like_a_blocked_one_are_not_blocked():
    machine = url_filter.Automaton(url_filter.METHOD_GLOBS)
    good = [".adsorption.org", ".sexton.com", ".pixels.edu", ".bannerman.ac.uk", ".www.slotsville.gov"]
    bad = [".ads.example.com", ".ads-server.example.com", ".ads7.example.com", ".www.banner12.net", ".casino"]
    hits = machine.match([h.encode() + b"\xff/" for h in good + bad]).any(axis=1).tolist()
    assert hits == [False] * len(good) + [True] * (len(bad) - 1) + [False]  # a host word is no top-level name
