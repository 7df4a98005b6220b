import pytest
from pyspark.sql import functions as F

from siltstone.functions.files import binary_content, binary_name, index_reason
from siltstone.functions.text import highlighted, lines, spans
from siltstone.operators import batch as B
from siltstone.operators import postings as P
from siltstone.operators import search as S
from siltstone.plans.pattern import plan

TEXTS = {
    1: "alpha\nneedle_one here\n",
    2: "fn needle_one() {}\nnope\n",
    3: "nothing\n",
    4: "foo123bar\nfoo bar\nfooXbar\n",
    5: "abc\r\nabcd\r\n",
    6: "",
    7: "\n",
    8: "\n\n",
    9: "one\ntwo",
    10: "abc\0def needle_one",
    11: None,
    12: "ab\nca\nxab-ab-y",
    13: "é1 needle one\n",
}


@pytest.fixture(scope="module")
def content(spark):
    return spark.createDataFrame([(k, f"d/{k}.txt", v) for k, v in TEXTS.items()], "file_id long, path string, text string").cache()


@pytest.fixture(scope="module")
def postings(content):
    return P.inverted(content.select("file_id", F.encode("text", "UTF-8").alias("content"))).cache()


def found(df):
    return sorted((r["file_id"], r["lineno"]) for r in df.collect())


def test_basic(content, postings):
    assert found(S.search(content, "needle_one")) == [(1, 2), (2, 1)]
    assert found(S.search(content, "needle_one", postings=postings)) == [(1, 2), (2, 1)]
    assert found(S.search(content, "absent_pattern", postings=postings)) == []
    assert found(S.search(content, "foo[0-9]+bar", postings=postings)) == [(4, 1)]
    assert found(S.search(content, "o.b", postings=postings)) == [(4, 2), (4, 3)]
    assert found(S.search(content, "FOOX", ignore_case=True, postings=postings)) == [(4, 3)]


def test_line_ends(content):
    assert found(S.search(content, "abc$")) == []
    assert [r["line"] for r in S.search(content, "abcd").collect()] == ["abcd"]
    assert [k for k in found(S.search(content, "^")) if k[0] in (6, 7, 8, 9)] == [(8, 1), (8, 2), (9, 1), (9, 2)]
    assert found(S.search(content, r"^\w\d needle.one$")) == [(13, 1)]


@pytest.mark.parametrize("pattern", ["needle", "foo", "foo.bar", "a", "ab|ca", "one", "tw+o", "(nee)dle", "x?yz", "abc\\b", "two$", "nope|needle_one", "bar{1,2}", "^fn"])
def test_narrowed_equals_scan(content, postings, pattern):
    stats = P.document_frequency(postings)
    scan = S.line_hits(content.filter(~binary_content(F.encode("text", "UTF-8"))), plan(pattern), prefilter=False)
    assert found(S.search(content, pattern, postings=postings, stats=stats, most_trigrams=2)) == found(scan)
    assert found(S.search(content, pattern, postings=postings, pushed=0)) == found(scan)


def test_partitioning_does_not_matter(spark, content):
    files = content.select("file_id", F.encode("text", "UTF-8").alias("content"))
    whole = sorted(map(tuple, P.inverted(files.coalesce(1)).select("trigram", "block", F.col("ids").cast("string")).collect()))
    for n in (1, 3, 8):
        assert sorted(map(tuple, P.inverted(files.repartition(n)).select("trigram", "block", F.col("ids").cast("string")).collect())) == whole


def test_blocks(spark):
    files = spark.createDataFrame([(5, bytearray(b"abcd")), (65540, bytearray(b"abc")), (65541, bytearray(b"bcd")), (70000, bytearray(b"abcd"))], "file_id long, content binary")
    postings = P.inverted(files)
    assert sorted((r["trigram"], r["block"], r["ids"]) for r in postings.collect()) == [(0x616263, 0, [5]), (0x616263, 1, [65540, 70000]), (0x626364, 0, [5]), (0x626364, 1, [65541, 70000])]
    assert sorted(r[0] for r in P.candidates(postings, [0x616263, 0x626364]).collect()) == [5, 70000]
    assert sorted(r[0] for r in P.posting_list(postings, 0x616263).collect()) == [5, 65540, 70000]
    assert P.posting_list(postings, 1).count() == 0
    stats = P.document_frequency(postings)
    assert P.rarest(stats, [0x616263, 0x626364], 1) == [0x616263] and P.rarest(stats, [1, 0x616263], 2) is None


@pytest.mark.parametrize(("line", "pattern", "expected"), [("xab-ab-y", "ab", [(1, 3), (4, 6)]), ("abc", "x*", []), ("abc", "^", []), ("abc", "abc", [(0, 3)]), ("aaaa", "aa", [(0, 2), (2, 4)])])
def test_spans(spark, line, pattern, expected):
    row = spark.createDataFrame([(line,)], "line string").select(spans(F.col("line"), plan(pattern).java).alias("s"), highlighted(F.col("line"), plan(pattern).java).alias("h")).first()
    assert [(s["start"], s["end"]) for s in row["s"]] == expected
    assert all(line[s["start"] : s["end"]] == s["text"] for s in row["s"])
    assert row["h"].replace("[", "").replace("]", "") == line and row["h"].count("[") == len(expected)


def test_shapes(content):
    hits = S.search(content, "foo")
    assert [r["value"] for r in S.grouped_text(hits).collect()] == ["d/4.txt\n1:foo123bar\n2:foo bar\n3:fooXbar"]
    assert sorted(r["value"] for r in S.flat_text(hits).collect())[0] == "d/4.txt:1:foo123bar"
    assert found(S.first_per_file(hits)) == [(4, 1)] and found(S.first_hits(hits, 2)) == [(4, 1), (4, 2)]
    assert tuple(S.hit_totals(hits).first()) == (3, 1) and S.hits_per_file(hits).first()["n_lines"] == 3


def test_written_text(content, spark, tmp_path):
    S.write_flat(S.search(content, "foo"), f"{tmp_path}/flat")
    assert spark.read.text(f"{tmp_path}/flat").count() == 3
    S.write_grouped(S.search(content, "needle_one"), f"{tmp_path}/grouped")
    assert "d/1.txt\n2:needle_one here" in "".join(p.read_text() for p in tmp_path.glob("grouped/part*"))


def test_batch(content, postings):
    patterns = {1: "needle_one", 2: "o.b", 3: "absent"}
    got = sorted((r["pattern_id"], r["file_id"], r["n_lines"]) for r in S.batch(content.filter("file_id <> 10"), patterns, postings).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 4, 2)]


def test_regular_expressions_see_only_lines_with_their_literals(spark):
    """Of each file and pattern only the lines that hold its literals in order are handed on, and the hits are those of a search."""
    texts = {1: "foo bar\nnothing\nbar foo\nof foo, of bar\n", 2: "\n\nxxy 7\n", 3: "", 4: None, 5: "foo\nbar", 6: "aé-b\r\nFOO abd"}
    content = spark.createDataFrame([(k, f"p{k}", t) for k, t in texts.items()], "file_id long, path string, text string")
    patterns = {1: "foo.*bar", 2: "of", 3: "[0-9]", 4: "(?i)foo", 5: "x{2}y", 6: "(ab|c)d", 7: "^$", 8: "é.b", 9: "foo\nbar", 10: "a.*(b)+", 11: "of.*of"}
    known = B.planned(spark.createDataFrame(list(patterns.items()), "pattern_id int, pattern string")).withColumn("number", F.col("pattern_id").cast("long"))
    got = {(r["file_id"], k): [r["lines"][x] for x in at] for r in B.pairs_in(content, known).collect() for k, at in zip(r["ids"], r["at"], strict=True)}
    assert got[1, 1] == ["foo bar", "of foo, of bar"] and got[1, 2] == got[1, 11] == ["of foo, of bar"] and got[2, 3] == ["", "", "xxy 7"]
    assert (5, 1) not in got and (5, 9) not in got and not any(file in (3, 4) for file, _ in got)
    hits = {(k, r["file_id"]): r["n_lines"] for k, p in patterns.items() for r in S.hits_per_file(S.search(content, p)).collect()}
    found = S.batch(content, patterns, P.inverted(content.filter("text is not null").select("file_id", F.encode("text", "UTF-8").alias("content")))).collect()
    assert {(r["pattern_id"], r["file_id"]): r["n_lines"] for r in found} == hits and len(found) == len(hits)


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\n",), ("a\n\nb",), ("",), ("\n",), ("\n\n",), (None,)], "s string")
    assert [r[0] for r in df.select(lines(F.col("s"))).collect()] == [["a", "b"], ["a", "", "b"], [], [], ["", ""], []]


def test_what_is_indexable(spark):
    names = {"x/report.PDF": True, "a.tar.gz": True, "main.rs": False, "Makefile": False, ".db": False, "d.db/x": False, "x/.hid.bin": True, "a.": False}
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r["path"]: r["b"] for r in df.select("path", binary_name(F.col("path")).alias("b")).collect()} == names
    bodies = [(b"fn main() {\r\n\tx\n}", False), (b"abc\0def", True), (b"%PDF" + b"ab\x01" * 50, True), ("é ü ß".encode(), False), (b"\x01" + b"a" * 19, False), (b"\x01" + b"a" * 18, True), (b"", False), (b"\x7f" * 2 + b"a" * 3, True)]
    df = spark.createDataFrame([(k, bytearray(b)) for k, (b, _) in enumerate(bodies)], "k int, c binary")
    assert [r["b"] for r in df.select("k", binary_content(F.col("c")).alias("b")).orderBy("k").collect()] == [w for _, w in bodies]
    df = spark.createDataFrame([("a", (64 << 20) + 1, None), ("a", 64 << 20, bytearray(b"x")), ("a.png", 1, bytearray(b"x")), ("a", 3, bytearray(b"a\0b")), ("a", 1, None)], "path string, size long, content binary")
    assert [r[0] for r in df.select(index_reason(F.col("path"), F.col("size"), F.col("content"))).collect()] == ["too_large", "ok", "binary_name", "nul", "unreadable"]
