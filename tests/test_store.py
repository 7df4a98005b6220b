import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import postings as P
from siltstone.operators import update as U
from siltstone.sources import corpus as C
from siltstone.sources.store import FANOUT, Index, Pieces, first_in_index, index_folder, search_index, summary
from siltstone.streaming import ingest

SCHEMA = "path string, mtime_ns long, size long, content binary"


def corpus(spark, files):
    """path -> text or (text, mtime)"""
    rows = []
    for path, value in files.items():
        text, mtime = value if isinstance(value, tuple) else (value, 1)
        rows.append((path, mtime, len(text.encode()), bytearray(text.encode())))
    return spark.createDataFrame(rows, SCHEMA)


def hits(index, files, pattern, **how):
    return sorted((r["path"], r["lineno"]) for r in search_index(index, files, pattern, **how).collect())


def test_build_update_rebuild(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", "r")
    first = corpus(spark, {"keep.txt": "keep_needle\n", "edit.txt": "before_needle\n", "gone.txt": "gone_needle\n"})
    assert index.update(first)["added"] == 3
    assert index.update(first) == {"added": 0, "changed": 0, "removed": 0, "unchanged": 3, "trigrams_rewritten": 0, "skipped_unreadable": 0}
    second = corpus(spark, {"keep.txt": "keep_needle\n", "edit.txt": ("after_needle\n", 2), "new.txt": "new_needle\n"})
    assert hits(index, second, "new_needle") == []  # no refresh unless asked
    manifest = spark.createDataFrame([("new.txt",), ("locked.txt",)], "path string")
    stats = index.update(second, manifest)
    assert {k: stats[k] for k in ("added", "changed", "removed", "unchanged", "skipped_unreadable")} == {"added": 1, "changed": 1, "removed": 1, "unchanged": 1, "skipped_unreadable": 1}
    ids = {r["path"]: r["file_id"] for r in index.files().collect()}
    assert ids == {"edit.txt": 1, "keep.txt": 3, "new.txt": 4}  # gone.txt had 2, which is not used again
    for pattern, expected in {"gone_needle": [], "before_needle": [], "after_needle": [("edit.txt", 1)], "needle": [("edit.txt", 1), ("keep.txt", 1), ("new.txt", 1)]}.items():
        assert hits(index, second, pattern) == expected
    stale = index.postings().select(F.explode("ids").alias("f")).filter("f = 2").count()
    assert stale > 0 and index.file(2).count() == 0
    index.compact(second)
    assert index.postings().select(F.explode("ids").alias("f")).filter("f = 2").count() == 0
    assert hits(index, second, "needle") == [("edit.txt", 1), ("keep.txt", 1), ("new.txt", 1)]
    compacted = summary(index.files(), index.postings()).first()["pairs"]
    index.build(second)
    assert summary(index.files(), index.postings()).first()["pairs"] == compacted
    assert {r["path"]: r["file_id"] for r in index.files().collect()} == {"edit.txt": 1, "keep.txt": 2, "new.txt": 3}


def test_highest_id_is_not_reused(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", "r")
    index.build(corpus(spark, {"a": "aaaa", "b": "bbbb"}))
    index.update(corpus(spark, {"a": "aaaa"}))
    index.update(corpus(spark, {"a": "aaaa", "c": "cccc"}))
    assert {r["path"]: r["file_id"] for r in index.files().collect()} == {"a": 1, "c": 3}


def test_touched_binary_and_zero_mtime(spark, tmp_path):
    old = spark.createDataFrame([(1, "t", 5, 4, None), (2, "z", 0, 4, None), (3, "flip", 5, 4, None), (4, "same", 7, 4, None)], U.FILES)
    old = old.withColumn("content_hash", F.xxhash64(F.lit(bytearray(b"text"))))
    new = corpus(spark, {"t": ("text", 6), "z": ("tixt", 0), "flip": ("te\0t", 9), "same": ("xxxx", 7), "bin": ("\0", 1), "add": ("text", 0)})
    got = {r["path"]: (r["status"], r["by"]) for r in U.diff(new, old).collect()}
    assert got == {"t": ("unchanged", "content"), "z": ("changed", "content"), "flip": ("removed", "content"), "same": ("unchanged", "stat"), "bin": ("ignored", "content"), "add": ("added", "content")}


def test_wrong_root_and_unfinished_build(spark, tmp_path):
    a = Index(spark, f"{tmp_path}/i", "a")
    a.build(corpus(spark, {"f": "secret_a"}))
    b = Index(spark, f"{tmp_path}/i", "b")
    assert b.manifest() is None
    assert hits(b, corpus(spark, {"g": "secret_b"}), "secret_a") == []
    assert hits(b, corpus(spark, {"g": "secret_b"}), "secret_b") == [("g", 1)]
    c = Index(spark, f"{tmp_path}/j", "c")
    corpus(spark, {"f": "x"}).write.parquet(f"{tmp_path}/j/gen-1/files")
    with pytest.raises(FileNotFoundError):
        c.files()
    assert hits(c, corpus(spark, {"f": "whole"}), "whole") == [("f", 1)]


def test_incremental_equals_rebuild(spark, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    one = {f"f{k}": f"{words[k % 5]} {words[k * 7 % 5]}\n{k}" for k in range(20)}
    two = {k: (v + " more", 2) if int(k[1:]) % 3 == 0 else v for k, v in one.items() if int(k[1:]) % 4} | {"g1": "alpha beta", "g2": "zeta"}
    index, fresh = Index(spark, f"{tmp_path}/i", "r"), Index(spark, f"{tmp_path}/j", "r")
    index.build(corpus(spark, one))
    index.update(corpus(spark, two))
    fresh.build(corpus(spark, two))
    for pattern in ("alpha", "beta.*more", "zeta", "more", "[0-9]", "omega delta"):
        assert hits(index, corpus(spark, two), pattern) == hits(fresh, corpus(spark, two), pattern)


def test_ids_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).selectExpr("concat('p', lpad(cast(id * 7919 % 1000 as string), 4, '0')) as path")
    for n in (1, 5):
        got = sorted((r["path"], r["file_id"]) for r in U.with_ids(rows.repartition(n), 10).select("path", "file_id").collect())
        assert [i for _, i in got] == list(range(11, 1011))


def test_tree_and_manifest(spark, tmp_path):
    root = tmp_path / "tree é"
    hidden = {".env": b"needle", "__init__.py": b"", ".github/ci.yml": b"x", "sub/_config.yml": b"y"}
    for name, data in ({"a.txt": b"needle\n", "sub/b c+%.txt": b"needle\r\n", ".git/x": b"needle", "sub/.git/y": b"needle", "blob.bin": b"ne\0edle"} | hidden).items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "link.txt").symlink_to(root / "a.txt")
    (root / "up").symlink_to(root)
    every = {r["path"]: bytes(r["content"]) for r in C.read_tree(spark, str(root)).collect()}
    assert set(every) == {"a.txt", "blob.bin", "sub/b c+%.txt", *hidden} and all(every[k] == v for k, v in hidden.items())
    named = spark.createDataFrame([(k,) for k in [*hidden, "gone", ".git/x", ".env"]], "path string")
    assert sorted(r["path"] for r in C.Tree(spark, str(root), named).listing().collect()) == sorted(hidden)
    assert {r["path"]: bytes(r["content"]) for r in C.Tree(spark, f"file://{root}", named).whole().collect()} == hidden
    files = C.read_tree(spark, str(root)).filter("path in ('a.txt', 'blob.bin', 'sub/b c+%.txt')")
    assert all(r["mtime_ns"] > 0 for r in C.read_tree(spark, str(root), content=False).collect())
    (tmp_path / "list").write_bytes(b"a.txt\0blob.bin\0locked\0a.txt\0")
    manifest = C.read_manifest(spark, str(tmp_path / "list"))
    assert sorted(r["path"] for r in C.listed(files, manifest).collect()) == ["a.txt", "blob.bin"]
    assert [r["path"] for r in C.missing(files, manifest).collect()] == ["locked"]
    index = Index(spark, index_folder(f"{tmp_path}/idx", str(root), spark), str(root))
    index.build(files)
    assert hits(index, files, "needle$") == [("a.txt", 1)] and hits(index, files, "needle") == [("a.txt", 1), ("sub/b c+%.txt", 1)]


def test_empty_corpus(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", "r")
    index.build(spark.createDataFrame([], SCHEMA))
    assert index.files().count() == 0 and hits(index, spark.createDataFrame([], SCHEMA), "abc") == []
    assert index.update(corpus(spark, {"a": "abcd"}))["added"] == 1


def test_stream_batches_are_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"doc number {k}\nneedle {k}") for k in range(30)], "doc_id long, text string")
    docs.repartition(6).write.parquet(f"{tmp_path}/in/docs.parquet")
    index = Index(spark, f"{tmp_path}/i", "r")
    stream = ingest.table_stream(spark, f"{tmp_path}/in/docs.parquet", 2)
    ingest.index_stream(stream, index, f"{tmp_path}/cp").awaitTermination()
    whole = Index(spark, f"{tmp_path}/j", "r")
    whole.build(C.from_table(docs))
    assert sorted(map(tuple, index.stats().collect())) == sorted(map(tuple, whole.stats().collect()))
    before = index.manifest()
    assert before["streams"] == {"stream": 2} and len(before["generations"]) == 3
    index.append(C.from_table(docs), 2)  # replay
    assert index.manifest() == before
    index.append(C.from_table(docs.limit(1).selectExpr("doc_id + 100 as doc_id", "text")), 0, "other")
    index.merge()
    after = index.manifest()
    assert after["streams"] == {"stream": 2, "other": 0} and len(after["generations"]) == 1 and index.files().count() == 31
    assert index.stats().filter("df > 1").agg(F.max("df")).first()[0] == 31
    assert index.postings().select(F.explode("ids").alias("f")).distinct().count() == 31
    hits_df = ingest.standing_search(ingest.table_stream(spark, f"{tmp_path}/in/docs.parquet", 2), "needle 1.$")
    ingest.hits_stream(hits_df, f"{tmp_path}/hits", f"{tmp_path}/cp2").awaitTermination()
    assert sorted((r["doc_id"], r["lineno"]) for r in spark.read.parquet(f"{tmp_path}/hits").collect()) == [(k, 2) for k in range(10, 20)]


def read_by(tree, work):
    """How many files the tree's tasks opened during ``work``, and its result."""
    before = tree.opened.value
    out = work()
    return tree.opened.value - before, out


def test_only_what_is_needed_is_read(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for k in range(400):
        (root / f"f{k:03}.txt").write_text(f"token{k} and more\n")
    index, tree = Index(spark, f"{tmp_path}/i", str(root)), C.Tree(spark, str(root))
    assert index.update(tree)["added"] == 400
    (root / "f007.txt").write_text("quite another text\n")
    opened, stats = read_by(tree, lambda: index.update(tree))
    assert (stats["changed"], stats["unchanged"]) == (1, 399) and stats["trigrams_rewritten"] > 0
    assert opened == 2  # to tell whether it is text, and to invert it
    assert read_by(tree, lambda: hits(index, tree, "token17 ")) == (1, [("f017.txt", 1)])
    assert read_by(tree, lambda: hits(index, tree, "quite")) == (1, [("f007.txt", 1)])
    assert read_by(tree, lambda: hits(index, tree, "absent needle")) == (0, [])


def test_what_is_no_text_is_read_once_or_never(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for name, data in {"a.txt": b"needle\n", "movie.mp4": b"needle", "report.PDF": b"needle", "nul.txt": b"needle\0" + b"x" * 20000, "odd.txt": b"\x01" * 600 + b"needle"}.items():
        (root / name).write_bytes(data)
    with open(root / "huge.txt", "wb") as f:
        f.truncate((64 << 20) + 1)
    with open(root / "just.txt", "wb") as f:
        f.write(b"some text\n" * 1000)
    index, tree = Index(spark, f"{tmp_path}/i", str(root)), C.Tree(spark, str(root))
    opened, stats = read_by(tree, lambda: index.update(tree))
    assert stats["added"] == 2 and opened == 4 + 2  # two are read twice, two by their heads
    assert tree.bytes_read.value == 2 * (7 + 10000) + 8192 + 606
    assert {r["path"]: r["reason"] for r in index.rejected().collect()} == {"movie.mp4": "binary_name", "report.PDF": "binary_name", "nul.txt": "nul", "odd.txt": "control", "huge.txt": "too_large"}
    before = index.manifest()
    opened, stats = read_by(tree, lambda: index.update(tree))
    assert opened == 0 and stats == {"added": 0, "changed": 0, "removed": 0, "unchanged": 2, "trigrams_rewritten": 0, "skipped_unreadable": 0}
    assert index.manifest() == before  # nothing was written either
    (root / "nul.txt").write_bytes(b"needle of text\n")
    (root / "a.txt").write_bytes(b"needle\0")
    (root / "movie.mp4").unlink()
    opened, stats = read_by(tree, lambda: index.update(tree))
    assert opened == 3 and (stats["added"], stats["removed"], stats["unchanged"]) == (1, 1, 1)
    assert {r["path"] for r in index.rejected().collect()} == {"a.txt", "report.PDF", "odd.txt", "huge.txt"}
    assert hits(index, tree, "needle") == [("nul.txt", 1)]


def test_heads_are_judged_alike(spark):
    import random

    from siltstone.functions.files import head_reason, index_reason

    chance = random.Random(2)
    rows = [bytes(chance.choice(b"\x01\x0b\x7f\x1f") if chance.random() < rate else chance.choice(b"ab \n\t\r\x80\xff\x0a") for _ in range(n)) for n in (0, 1, 19, 20, 21, 400, 9000) for rate in (0.0, 0.04, 0.05, 0.06) for _ in range(4)]
    rows += [b"a" * 8191 + b"\0", b"a" * 8192 + b"\0", b"\x01" + b"a" * 19, b"\x01" + b"a" * 18]
    frame = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(rows)], "k int, content binary")
    got = {r["k"]: r["reason"] for r in frame.select("k", index_reason(F.lit("f.txt"), F.octet_length("content").cast("long"), F.col("content")).alias("reason")).collect()}
    assert got == {k: head_reason(r[:8192]) or "ok" for k, r in enumerate(rows)}


def deep(root, names):
    """Make folders inside one another whose whole path the system can't open, with a file in the last."""
    import os

    at = os.open(root, os.O_RDONLY)
    for name in names:
        os.mkdir(name, dir_fd=at)
        inner = os.open(name, os.O_RDONLY, dir_fd=at)
        os.close(at)
        at = inner
    os.write(file := os.open("file.txt", os.O_CREAT | os.O_WRONLY, dir_fd=at), b"needle deep\n")
    os.close(file)
    os.close(at)


def test_a_root_that_cannot_be_listed_changes_nothing(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    (root / "a.txt").write_text("needle\n")
    index, tree = Index(spark, f"{tmp_path}/i", "r"), C.Tree(spark, str(root))
    index.update(tree)
    before = index.manifest()
    root.rename(tmp_path / "moved")
    for gone in (tree, C.Tree(spark, str(root), spark.createDataFrame([("a.txt",)], "path string"))):
        with pytest.raises(OSError):
            index.update(gone)
    (tmp_path / "file").write_text("no folder")
    with pytest.raises(OSError):
        index.update(C.Tree(spark, f"{tmp_path}/file"))
    assert index.manifest() == before and index.files().count() == 1
    assert hits(index, C.Tree(spark, f"{tmp_path}/moved"), "needle") == [("a.txt", 1)]


def test_a_folder_that_cannot_be_listed_is_counted_and_its_files_stay(spark, tmp_path):
    short, long = tmp_path / "t", tmp_path
    names = ["d" * 250] * 14
    short.mkdir()
    (short / "a.txt").write_text("needle\n")
    deep(short, names)
    index = Index(spark, f"{tmp_path}/i", "r")
    assert index.update(C.Tree(spark, str(short)))["added"] == 2
    for k in range(4):  # the same tree below a longer path, so its last folders can't be opened
        long = long / ("p" * 200)
        long.mkdir()
    short.rename(long / "t")
    tree = C.Tree(spark, f"{long}/t")
    assert tree.unreadable().count() == 1
    stats = index.update(tree)
    assert (stats["unchanged"], stats["removed"], stats["skipped_unreadable"]) == (2, 0, 1) and index.files().count() == 2
    by = {r["path"][:5]: r["by"] for r in U.diff(tree, index.files()).collect()}
    assert by == {"a.txt": "stat", "ddddd": "unlisted"}
    stats = index.update(tree, keep_unlisted=False)
    assert (stats["unchanged"], stats["removed"], stats["skipped_unreadable"]) == (1, 1, 1) and index.files().count() == 1


def test_a_flat_folder_is_listed_by_several_tasks(spark, tmp_path):
    names = [f"n{k}" for k in range(C._PAGE * 2 + 500)]
    for name in names:
        open(tmp_path / name, "w").close()
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x").write_text("x")
    tree = C.Tree(spark, str(tmp_path))
    found = tree._found()
    assert found.filter("kind = 'pages'").select("path", "size").collect() == [("", 3)]
    per_task = found.filter("kind = 'file'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) >= 3 and max(r["count"] for r in per_task) < C._PAGE
    assert sorted(r["path"] for r in tree.listing().collect()) == sorted([*names, "sub/x"])


class Killed(Exception):
    pass


def test_a_tree_build_goes_on_where_it_was_killed(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for k in range(20):
        (root / f"f{k:02}.txt").write_text(f"token{k} and more {k * 7}\n")
    (root / "f05.pdf").write_bytes(b"no text")
    (root / "f06.dat.txt").write_bytes(b"\0")
    tree = C.Tree(spark, str(root))
    whole = Index(spark, f"{tmp_path}/whole", "r")
    whole.build(tree)
    index, done = Index(spark, f"{tmp_path}/i", "r"), []
    take = index._taken_in

    def killed(*args):
        if len(done) == 3:
            raise Killed
        done.append(args)
        return take(*args)

    index._taken_in = killed
    with pytest.raises(Killed):
        index.build(tree, pieces=Pieces(files=5))
    assert index.manifest() is None  # unfinished, so readers see nothing
    assert len(index._latest()["building"]["done"]) == 3 and len(index._latest()["building"]["pieces"]) == 5
    again = Index(spark, f"{tmp_path}/i", "r")
    opened, _ = read_by(tree, lambda: again.build(tree))
    assert opened == 2 * (22 - 15)  # the last two pieces only: files 15 to 21 of the listing
    assert len(again.manifest()["generations"]) == 5 and again.manifest()["building"] is None

    def held(i):
        lists = i.postings().groupBy("trigram").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids"))
        return sorted((r["trigram"], tuple(r["ids"])) for r in lists.collect()), sorted((r["path"], r["file_id"], r["content_hash"]) for r in i.files().collect()), sorted(map(tuple, i.rejected().collect()))

    assert held(again) == held(whole)
    assert again.update(tree)["unchanged"] == 20
    assert hits(again, tree, "token17 ") == [("f17.txt", 1)]


def test_pieces_are_bounded_by_files_bytes_and_trigrams(spark, tmp_path):
    files = spark.createDataFrame([(f"p{k:03}", 1, 10 if k < 50 else 1000) for k in range(100)], "path string, mtime_ns long, size long")
    index = Index(spark, f"{tmp_path}/i", "r")
    for pieces, n_files, n_bytes in ((Pieces(files=8), 8, 10**9), (Pieces(bytes=2500), 100, 2500), (Pieces(trigrams=2500), 100, 2500), (Pieces(files=8, bytes=2500), 8, 2500)):
        got = index._cut(files, pieces).groupBy("piece").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.min("path").alias("a"), F.max("path").alias("z")).orderBy("piece").collect()
        assert len(got) > 5 and all(r["n"] <= n_files + 1 and r["b"] <= n_bytes + 1000 for r in got), (pieces, got)
        assert all(x["z"] < y["a"] for x, y in zip(got, got[1:])) and sum(r["n"] for r in got) == 100


def test_many_small_updates_merge_with_their_like(spark, tmp_path):
    files = {f"b{k:03}": f"base{k} text" for k in range(70)}
    index = Index(spark, f"{tmp_path}/i", "r")
    index.build(corpus(spark, files))
    sizes, rewritten, most = len(files), 0, 0
    merged = index._merged

    def counted(generations, level):
        nonlocal rewritten
        rewritten += sum(g["files"] for g in generations)
        return merged(generations, level)

    index._merged = counted
    n = 20
    for k in range(n):
        files[f"n{k:03}"] = f"token{k} new"
        index.append(corpus(spark, {f"n{k:03}": files[f"n{k:03}"]}), k)
        most = max(most, len(index.manifest()["generations"]))
    levels = [g["level"] for g in index.manifest()["generations"]]
    assert levels == sorted(levels, reverse=True) and most <= 1 + (FANOUT - 1) * 2
    assert rewritten == 8 * (n // 8)  # and not the 70 that were there
    assert index.files().count() == sizes + n and hits(index, corpus(spark, files), "token1") == sorted((p, 1) for p, t in files.items() if "token1" in t)


def test_merged_generations_remember_what_they_replaced(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/i", "r")
    files = {k: f"text of {k}" for k in "abcdefgh"}
    index.build(corpus(spark, files))
    for step in range(FANOUT):
        files = {k: (f"step{step} of {k}", step + 2) if k == "ab"[step % 2] else v for k, v in files.items() if k != "defgh"[step % 5] or step > 4}
        index.update(corpus(spark, files))
    assert [g["level"] for g in index.manifest()["generations"]] == [1, 1]
    assert sorted(r["path"] for r in index.files().collect()) == sorted(files)
    for pattern in ("step7", "step6", "step5", "text of c", "text of d"):
        want = sorted((k, 1) for k, v in files.items() if pattern in (v[0] if isinstance(v, tuple) else v))
        assert hits(index, corpus(spark, files), pattern) == want
    index.merge()
    assert len(index.manifest()["generations"]) == 1 and sorted(r["path"] for r in index.files().collect()) == sorted(files)


def test_writers_at_the_same_time_both_count(spark, tmp_path):
    files = {"a": "alpha", "b": "beta"}
    index, other = Index(spark, f"{tmp_path}/i", "r"), Index(spark, f"{tmp_path}/i", "r")
    index.build(corpus(spark, files))
    commit, met = index._commit, []

    def late(before, change):
        if not met:
            met.append(other.append(corpus(spark, {"c": "gamma"}), 0))
        return commit(before, change)

    index._commit = late
    assert index.append(corpus(spark, {"d": "delta"}), 0, "mine") is None
    assert {r["path"]: r["file_id"] for r in index.files().collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}
    assert index.manifest()["streams"] == {"stream": 0, "mine": 0}
    met.clear()
    stats = index.update(corpus(spark, {**files, "c": "gamma", "d": "delta changed", "e": "epsilon"}))
    assert (stats["added"], stats["changed"]) == (1, 1)
    assert hits(index, corpus(spark, {**files, "c": "gamma", "d": "delta changed", "e": "epsilon"}), "delta changed|epsilon") == [("d", 1), ("e", 1)]


def test_a_search_outlives_builds_and_merges(spark, tmp_path):
    files = {"a": "needle alpha", "b": "beta"}
    index = Index(spark, f"{tmp_path}/i", "r")
    index.build(corpus(spark, files))
    begun = search_index(index, corpus(spark, files), "needle")
    index.update(corpus(spark, {**files, "c": "needle too"}))
    index.compact(corpus(spark, {**files, "c": "needle too"}))
    index.build(corpus(spark, {"z": "other"}))
    assert [(r["path"], r["lineno"]) for r in begun.collect()] == [("a", 1)]
    for _ in range(index.keep):
        index.merge()
    names = [n for n in index.store.names() if not n.startswith(".")]
    assert len([n for n in names if n.startswith("manifest")]) == index.keep and len([n for n in names if n.startswith("gen")]) == index.keep


def test_forward_rows_give_the_delta(spark, tmp_path):
    old = {f"f{k}": f"text number {k} of many" for k in range(30)}
    new = {**old, "f7": ("text number 7 of quite different", 2), "g": "brand new"}
    fast, slow = Index(spark, f"{tmp_path}/i", "r", forward=True), Index(spark, f"{tmp_path}/j", "r")
    stats = []
    for index in (fast, slow):
        index.build(corpus(spark, old))
        stats.append(index.update(corpus(spark, new)))
    assert stats[0] == stats[1] and stats[0]["changed"] == 1
    pairs = [sorted(map(tuple, i.postings().select("trigram", F.explode("ids")).collect())) for i in (fast, slow)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == len(set(pairs[0]))
    gone = {**new, "f7": ("text", 3)}  # no new trigram, fewer old ones
    assert fast.update(corpus(spark, gone))["trigrams_rewritten"] == 0
    seven = [r["file_id"] for r in fast.files().filter("path = 'f7'").collect()]
    assert [sorted(r["trigrams"]) for r in fast.trigrams_of(seven).collect()] == [sorted({(a << 16) | (b << 8) | c for a, b, c in zip(b"text", b"ext", b"xt")})]
    plan = fast.trigrams_of([7])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(fblock" in plan and "PushedFilters: [IsNotNull(file_id), EqualTo(file_id,7)]" in plan
    for index in (fast, slow):
        index.merge()
        again = index.update(corpus(spark, {**gone, "f7": ("text number 7 of many", 4)}))
        assert again["changed"] == 1
    assert hits(fast, corpus(spark, {**gone, "f7": ("text number 7 of many", 4)}), "7 of many") == hits(slow, corpus(spark, {**gone, "f7": ("text number 7 of many", 4)}), "7 of many") == [("f17", 1), ("f27", 1), ("f7", 1)]


def test_sketches_are_close(spark, tmp_path):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('doc ', sha2(cast(id as string), 512), sha2(cast(id * 31 as string), 512)) as text")
    index = Index(spark, f"{tmp_path}/i", "r")
    index.append(C.from_table(docs.filter("doc_id < 250")), 0)
    index.append(C.from_table(docs.filter("doc_id >= 250")), 1)
    got = index.approximate().first()
    exact = index.stats().count()
    assert abs(got["distinct_trigrams"] - exact) <= 0.02 * exact
    lengths = sorted(r["df"] for g in index.manifest()["generations"] for r in spark.read.parquet(index.store.at(g["name"], "stats")).collect())
    assert got["lists"] == len(lengths)
    for q, name in ((0.5, "median_length"), (0.99, "p99_length")):
        near = [lengths[max(0, min(len(lengths) - 1, int((q + d) * len(lengths))))] for d in (-0.03, 0.03)]
        assert near[0] <= got[name] <= near[1]
    assert Index(spark, f"{tmp_path}/j", "r")._latest()["number"] == 0


def test_sparse_ids_invert_in_one_pass():
    import time

    import pyarrow as pa

    from siltstone.operators import postings as P

    ids = np.arange(8000) * P.BLOCK * 3 + 5
    batch = pa.RecordBatch.from_arrays([pa.array(ids[::-1].copy()), pa.array([b"abcd"] * 8000, pa.binary())], names=["file_id", "content"])
    began = time.time()
    out = pa.Table.from_batches(list(P._inverted_batch(batch)))
    assert time.time() - began < 3
    assert out.num_rows == 16000 and sorted({x[0] for x in out.column("ids").to_pylist()}) == ids.tolist()


def test_many_patterns_find_what_search_finds(spark, tmp_path):
    from siltstone.operators import search as S

    files = {"a": "needle one\nneedle two", "b": "nothing", "bin": "needle\0", "gone": "needle gone", "c": "an orange"}
    index = Index(spark, f"{tmp_path}/i", "r")
    index.build(corpus(spark, {k: v.replace("\0", "") for k, v in files.items()}))
    index.update(corpus(spark, {k: v.replace("\0", "") for k, v in files.items() if k != "gone"}))
    ids = {"a": 1, "b": 2, "bin": 3, "c": 4, "gone": 5}
    content = spark.createDataFrame([(ids[k], k, v) for k, v in files.items()], "file_id long, path string, text string")
    patterns = {1: "needle", 2: "o.*e", 3: "range", 4: "zzzz"}
    got = sorted(map(tuple, S.batch(content, patterns, index.postings(), index.stats(), index.files()).collect()))
    want = []
    for k, p in patterns.items():
        found = S.search(content, p, postings=index.postings(), stats=index.stats(), files=index.files())
        want += [(k, r["file_id"], r["n_lines"]) for r in S.hits_per_file(found).collect()]
    assert got == sorted(want) and got


def test_thousands_of_patterns_in_one_plan(spark, tmp_path, monkeypatch):
    from siltstone.operators import batch as B
    from siltstone.operators import search as S
    from siltstone.plans.pattern import PatternError

    texts = [f"alpha{k} beta{k % 7} line\nsecond é{k} gamma{k % 3}\r\n" for k in range(60)] + ["", "bin\0alpha1", None, "alpha5 " * 500]
    content = spark.createDataFrame([(k, f"p{k}", t) for k, t in enumerate(texts)], "file_id long, path string, text string")
    index = Index(spark, f"{tmp_path}/i", "r")
    index.build(content.filter("text is not null").selectExpr("path", "1L as mtime_ns", "octet_length(text) + 0L as size", "encode(text, 'UTF-8') as content", "file_id").filter("file_id <> 3"), ids="file_id")
    patterns = {k: f"alpha{k}( |$)" for k in range(5000)} | {5001: "beta3.*line", 5002: "é5[0-9]", 5003: "a|b", 5004: "gamma2$", 5005: "gamma2\\r?$", 5006: "zzz"}
    few = {k: patterns[k] for k in (1, 5, 59, 61, 4999, 5001, 5002, 5004, 5005, 5006)}

    def found(some):
        frame = spark.createDataFrame(list(some.items()), "pattern_id int, pattern string").repartition(3)
        out = B.batch_table(content, frame, index.postings(), index.stats(), index.files())
        return out, sorted(map(tuple, out.collect()))

    want = []
    for k, p in few.items():
        hits_ = S.search(content, p, postings=index.postings(), stats=index.stats(), files=index.files())
        want += [(k, r["file_id"], r["n_lines"]) for r in S.hits_per_file(hits_).collect()]
    small, got = found(few)
    assert got == sorted(want) and {k for k, *_ in got} >= {1, 5, 59, 5001, 5002}
    many, got = found(patterns)
    assert [r for r in got if r[0] in few] == sorted(want)
    assert {r[1] for r in got if r[0] == 5003} == {k for k in range(64) if k not in (3, 60, 61, 62)}  # no literal: all live text is read
    size = [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (small, many)]
    assert size[1] < 2 * size[0]  # ids of at most a thousand candidates may be pushed in one and not in the other
    monkeypatch.setattr(B, "_SLICE", 4)
    monkeypatch.setattr(B, "_TOGETHER", 1)
    assert found(few)[1] == sorted(want)
    with pytest.raises(PatternError):
        found({1: "fine", 2: "(open"})
    with pytest.raises(PatternError):
        found({1: "x{3,1}"})
    assert B.batch_table(content, spark.createDataFrame([], "pattern_id int, pattern string"), index.postings(), index.stats()).count() == 0


def test_first_hits_read_little(spark, tmp_path):
    root = tmp_path / "t"
    root.mkdir()
    for k in range(600):
        (root / f"f{k:03}.txt").write_text("common word\n" * (k % 3) + f"token{k} rare\n" + ("late needle\n" if k > 560 else "late ned, needl\n"))
    index, tree = Index(spark, f"{tmp_path}/i", str(root)), C.Tree(spark, str(root))
    index.build(tree)
    every = {p: sorted((r["file_id"], r["lineno"], r["line"]) for r in search_index(index, tree, p).collect()) for p in ("common", "late n(eedle)?$", "[0-9]9 rare", "nowhere at all")}
    for pattern, hits_ in every.items():
        for n in (1, 10, 10_000):
            opened, got = read_by(tree, lambda p=pattern, n=n: first_in_index(index, tree, p, n).collect())
            assert [(r["file_id"], r["lineno"], r["line"]) for r in got] == hits_[:n]
            if pattern == "common" and n <= 10:
                assert opened == 32
    from siltstone.operators import search as S
    from siltstone.plans.pattern import plan

    live = index.files().select("path", "size", "file_id")

    def read(rows):
        return tree.reading(rows).select("file_id", "path", F.decode("content", "UTF-8").alias("text"))

    got = S.first_hits_of(live, read, plan("late needle"), 3, first=2, most=100)
    assert [r["file_id"] for r in got.collect()] == [562, 563, 564]


def _lists(spark, rows):
    return spark.createDataFrame(rows, "trigram int, block long, ids array<long>")


def test_lists_are_compared_without_a_row_for_each_pair(spark):
    new = _lists(spark, [(1, 0, [1, 5]), (1, 0, [3]), (2, 0, [5]), (3, 1, [70000])])
    old = _lists(spark, [(1, 0, [3, 4]), (1, 0, [1]), (2, 0, [5, 6]), (4, 0, [9])])
    changed = spark.createDataFrame([(3,), (5,)], "file_id long")

    def rows(frame):
        return sorted((r["trigram"], r["block"], r["ids"]) for r in frame.collect())

    assert rows(P.lacking(new, old)) == [(1, 0, [5]), (3, 1, [70000])]
    assert rows(P.lacking(new, old, changed)) == [(1, 0, [1, 5]), (3, 1, [70000])]  # 1 is no changed file
    assert rows(P.lacking(new, old, size=1 << 30)) == [(1, 0, [5]), (3, 1, [70000])]
    assert rows(P.in_both(old, new)) == [(1, 0, [1, 3]), (2, 0, [5])]
    files = spark.createDataFrame([(6,), (3,)], "file_id long")
    assert {r["cause"]: r["pairs"] for r in P.stale(old, new, files).collect()} == {"lost_trigram": 1, "tombstone": 2}
    plan = P.lacking(new, old)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_more_text_is_joined_by_more_tasks(spark):
    lists = spark.range(1000).selectExpr("cast(id as int) as trigram", "id * 9 as block", "array(id) as ids")
    few, many = (P.joined_lists(lists, size=size) for size in (0, 10 * P._TASK))
    assert many.rdd.getNumPartitions() == 10 > few.rdd.getNumPartitions()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_files_of_a_tree_are_written_and_deleted_by_tasks(spark, tmp_path):
    files = spark.createDataFrame([(f"d{k % 3}/f{k}", b"x") for k in range(60)], "path string, content binary").coalesce(1)
    assert C._dealt(files).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    C.write_tree(files, str(tmp_path))
    assert C.Tree(spark, str(tmp_path)).listing().count() == 60
    missing = spark.createDataFrame([("d0/none",)], "path string")
    C.delete_files(files.select("path").union(missing), str(tmp_path))
    assert C.Tree(spark, str(tmp_path)).listing().count() == 0
