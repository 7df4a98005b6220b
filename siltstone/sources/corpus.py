"""Corpora: a tree of files, a manifest of paths, or a table of documents.

A corpus tells what there is (path, mtime_ns, size) apart from what is in it, so that
an update reads only what changed, and a search only its candidates.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import head_reason, index_reason, stat_reason
from ..shared import checkpointed

LISTING = "path string, mtime_ns long, size long"

#: Bytes of content that a task reads, and that a batch of rows holds, about.
_TASK_BYTES, _BATCH_BYTES = 128 << 20, 16 << 20
#: So many paths at most are pushed into a table's scan.
_PUSHED = 1000
#: A folder of more names than this is listed by several tasks.
_PAGE = 20000
#: By so many at most: each reads all of its names, and looks up its own.
_PAGES = 16


def _store(root: str):
    """The file system of a root and the root's path in it; for use inside tasks."""
    from pyarrow import fs

    local = root.removeprefix("file://").removeprefix("file:")
    if "://" not in local:
        return fs.LocalFileSystem(), local.rstrip("/") or "/"
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")


Entry = tuple[str, int, int, str]


def _scanned(base: str, folder: str, page: int, pages: int) -> Iterator[Entry]:
    """(path, mtime_ns, size, kind) in a local folder: files and folders that are no links, but for .git.

    With ``pages`` only the names of one page, by their hash; with none, a folder of more than
    ``_PAGE`` names gives one row of kind pages (their number, at most ``_PAGES``, as its size) in place of its entries.
    """
    try:
        if not pages:
            with os.scandir(f"{base}/{folder}") as names:
                n = sum(1 for _ in names)
            if n > _PAGE:
                yield folder, 0, min(-(-n // _PAGE), _PAGES), "pages"
                return
        with os.scandir(f"{base}/{folder}") as names:
            for entry in names:
                if (pages and zlib.crc32(os.fsencode(entry.name)) % pages != page) or entry.name == ".git":
                    continue
                path = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    path.encode()
                    if entry.is_dir(follow_symlinks=False):
                        yield path, 0, 0, "folder"
                    elif entry.is_file(follow_symlinks=False):
                        info = entry.stat(follow_symlinks=False)
                        yield path, info.st_mtime_ns, info.st_size, "file"
                except UnicodeEncodeError:
                    yield os.fsencode(path).decode("utf-8", "replace"), 0, 0, "unreadable"
                except FileNotFoundError:
                    continue  # gone meanwhile
                except OSError:
                    yield path, 0, 0, "unreadable"
    except FileNotFoundError:
        if not folder:
            yield folder, 0, 0, "unreadable"
    except OSError:
        yield folder, 0, 0, "unreadable"


def _entries(store, base: str, folder: str, page: int, pages: int) -> Iterator[Entry]:
    """What ``_scanned`` gives, in any store. Those that are not local give a folder's entries as one list."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        yield from _scanned(base, folder, page, pages)
        return
    try:
        found = store.get_file_info(fs.FileSelector(f"{base}/{folder}"))
    except OSError:
        yield folder, 0, 0, "unreadable"
        return
    for info in found:
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.base_name != ".git" and info.type in (fs.FileType.Directory, fs.FileType.File):
            yield (path, info.mtime_ns or 0, info.size, "file") if info.type == fs.FileType.File else (path, 0, 0, "folder")


def _stat(store, base: str, path: str, page: int, pages: int) -> Iterator[Entry]:
    from pyarrow import fs

    try:
        info = store.get_file_info(f"{base}/{path}")
    except OSError:
        info = None
    if info is not None and info.type == fs.FileType.File:
        yield path, info.mtime_ns or 0, info.size, "file"
    else:
        yield path, 0, 0, "unreadable"


def _looked_up(rows: DataFrame, root: str, look) -> DataFrame:
    """Entries of (path, page, pages), written out some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            asked = zip(*(batch.column(c).to_pylist() for c in ("path", "page", "pages")), strict=True)
            found = (e for x in asked for e in look(store, base, *x))
            while some := list(itertools.islice(found, 4096)):
                columns = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "mtime_ns", "size", "kind"])

    return rows.select("path", "page", "pages").mapInArrow(run, f"{LISTING}, kind string")


class Corpus:
    """What there is, and a way to read some of it."""

    def entries(self) -> DataFrame:
        """(path, mtime_ns, size, kind), each path once; kind is file, or unreadable for what could not be listed."""
        return self.listing().withColumn("kind", F.lit("file"))

    def listing(self) -> DataFrame:
        """(path, mtime_ns, size) of the files."""
        return self.entries().filter("kind = 'file'").drop("kind")

    def reading(self, rows: DataFrame, count: int | None = None) -> DataFrame:
        """``rows`` (path and whatever else; ``count`` of them, if known) with ``content``; paths that can't be read are left out."""
        raise NotImplementedError

    def judged(self, rows: DataFrame | None = None) -> DataFrame:
        """``rows`` (path, mtime_ns, size; else all) with ``reason`` and ``content``, which is null unless reason is ok.

        What the listing rules out is not read, and what the head of a file rules out is read no further.
        """
        raise NotImplementedError

    def whole(self) -> DataFrame:
        """(path, mtime_ns, size, content) of everything."""
        return self.reading(self.listing())


class Tree(Corpus):
    """Files below a root, in any store that pyarrow opens; names may start with a dot or underscore.

    Folders are listed in tasks, one level of the tree after another; a local folder of very many
    names is dealt to several. Links are not followed and .git folders are left out. A root
    that can't be listed is an error; folders below it that can't are rows of their own. With
    ``paths`` (a DataFrame, such as a version control system lists) these are the listing, and only
    they are looked up. ``opened`` and ``bytes_read`` count what tasks have read so far.
    """

    def __init__(self, spark: SparkSession, root: str, paths: DataFrame | None = None):
        self.spark, self.root, self.paths = spark, root, paths
        self.opened, self.bytes_read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def _root_error(self) -> OSError:
        return OSError(f"{self.root} is no folder that can be listed")

    def _found(self) -> DataFrame:
        from pyarrow import fs

        store, base = _store(self.root)
        if store.get_file_info(base).type != fs.FileType.Directory:
            raise self._root_error()
        if self.paths is not None:
            inside = self.paths.select("path").distinct().filter(~F.col("path").rlike(r"(^|/)\.git(/|$)"))
            return _looked_up(inside.withColumns({"page": F.lit(0), "pages": F.lit(0)}), self.root, _stat)
        out, now = None, self.spark.createDataFrame([("", 0, 0)], "path string, page int, pages int")
        while True:
            level = checkpointed(_looked_up(now, self.root, _entries))
            if out is None and not level.filter("kind = 'unreadable' and path = ''").isEmpty():
                raise self._root_error()
            out = level if out is None else out.union(level)
            folders = level.filter("kind = 'folder'").select("path", F.lit(0).alias("page"), F.lit(0).alias("pages"))
            pages = level.filter("kind = 'pages'").select("path", F.expr("explode(sequence(0, cast(size as int) - 1))").alias("page"), F.col("size").cast("int").alias("pages"))
            now = folders.union(pages).repartition(self.spark.sparkContext.defaultParallelism)
            if now.isEmpty():
                return out

    def entries(self) -> DataFrame:
        return self._found().filter("kind in ('file', 'unreadable')")

    def unreadable(self) -> DataFrame:
        """(path) of folders that could not be listed, and of paths of the manifest that are no files."""
        return self.entries().filter("kind = 'unreadable'").select("path")

    def reading(self, rows: DataFrame, count: int | None = None) -> DataFrame:
        return self._read(rows, False)

    def judged(self, rows: DataFrame | None = None) -> DataFrame:
        rows = (self.listing() if rows is None else rows).withColumn("reason", stat_reason(F.col("path"), F.col("size")))
        read = self._read(rows.filter("reason is null").drop("reason"), True)
        return read.unionByName(rows.filter("reason is not null"), allowMissingColumns=True)

    def _read(self, rows: DataFrame, judge: bool) -> DataFrame:
        """``rows`` with ``content``. To judge, the head is read first, and all rows stay, with ``reason``."""
        root, opened, bytes_read = self.root, self.opened, self.bytes_read
        kept = rows.drop("content", "reason")
        if "size" in kept.columns:
            total = kept.agg(F.sum("size")).first()[0] or 0
            kept = kept.repartition(max(self.spark.sparkContext.defaultParallelism, -(-total // _TASK_BYTES)))

        def read(store, name: str) -> tuple[str, bytes | None]:
            try:
                with store.open_input_stream(name, compression=None) as f:
                    opened.add(1)
                    head = f.read(8192) if judge else b""
                    reason = head_reason(head) if judge else None
                    data = None if reason else head + f.read()
                    bytes_read.add(len(head if data is None else data))
                    return reason or "ok", data
            except OSError:
                return "unreadable", None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = _store(root)

            def made(batch: pa.RecordBatch, places: list[int], reasons: list[str], content: list[bytes | None]) -> pa.RecordBatch:
                own = batch.take(pa.array(places, pa.int64()))
                more = [("content", pa.array(content, pa.binary()))] + ([("reason", pa.array(reasons, pa.string()))] if judge else [])
                return pa.RecordBatch.from_arrays([*own.columns, *(c for _, c in more)], names=[*own.schema.names, *(n for n, _ in more)])

            for batch in batches:
                places, reasons, content, held = [], [], [], 0
                for k, path in enumerate(batch.column("path").to_pylist()):
                    reason, data = read(store, f"{base}/{path}")
                    if data is None and not judge:
                        continue
                    places.append(k)
                    reasons.append(reason)
                    content.append(data)
                    held += len(data or b"")
                    if held >= _BATCH_BYTES:
                        yield made(batch, places, reasons, content)
                        places, reasons, content, held = [], [], [], 0
                yield made(batch, places, reasons, content)

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        return kept.mapInArrow(run, f"{fields}, content binary" + (", reason string" if judge else ""))


class Table(Corpus):
    """A DataFrame of (path, mtime_ns, size, content); listings leave its content column unread."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def entries(self) -> DataFrame:
        return self.frame.select("path", "mtime_ns", "size", F.lit("file").alias("kind"))

    def dealt(self, tasks: int, most: int) -> Table:
        """The same in ``tasks`` parts, written out, if the planner takes it for at most ``most`` bytes; else as it is.

        All of a little text may be in one row group, and so in one task.
        """
        size = int(self.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return Table(checkpointed(self.frame.repartition(tasks))) if size <= most else self

    def reading(self, rows: DataFrame, count: int | None = None) -> DataFrame:
        """With few rows their paths are pushed into the scan; with many, rows and content are joined."""
        rows, content = rows.drop("content"), self.frame.select("path", "content")
        few = [r[0] for r in rows.select("path").limit(_PUSHED + 1).collect()] if count is None or count <= _PUSHED else []
        if max(len(few), count or 0) > _PUSHED:
            return rows.join(content, "path")
        return content.filter(F.col("path").isin(few) if few else F.lit(False)).join(F.broadcast(rows), "path")  # at most _PUSHED rows

    def judged(self, rows: DataFrame | None = None) -> DataFrame:
        read = self.whole() if rows is None else self.reading(rows)
        read = read.withColumn("reason", index_reason(F.col("path"), F.col("size"), F.col("content")))
        return read.withColumn("content", F.when(F.col("reason") == "ok", F.col("content")))

    def whole(self) -> DataFrame:
        return self.frame


def _dealt(frame: DataFrame) -> DataFrame:
    """The frame in a part for each core at least."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


def write_tree(files: DataFrame, root: str) -> None:
    """Write (path, content) as files below ``root``; a file that is there is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{path}", compression=None) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    _dealt(files.select("path", "content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def delete_files(paths: DataFrame, root: str) -> None:
    """Delete the files of (path) below ``root`` in tasks; those that are not there are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    store.delete_file(f"{base}/{path}")
                except FileNotFoundError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    _dealt(paths.select("path")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def as_corpus(corpus: Corpus | DataFrame) -> Corpus:
    return Table(corpus) if isinstance(corpus, DataFrame) else corpus


def read_tree(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """All files below ``root`` but those in .git folders; unreadable and vanished ones are skipped."""
    tree = Tree(spark, root)
    return tree.whole() if content else tree.listing()


def from_table(docs: DataFrame, path: str = "doc_id", text: str = "text", mtime: str | None = None) -> DataFrame:
    """A table with a key and a text as a corpus; null texts have null content and size."""
    content = F.encode(F.col(text), "UTF-8") if dict(docs.dtypes)[text] == "string" else F.col(text)
    return docs.select(F.col(path).cast("string").alias("path"), (F.col(mtime) if mtime else F.lit(0)).cast("long").alias("mtime_ns"), F.octet_length(content).cast("long").alias("size"), content.alias("content"))


def read_manifest(spark: SparkSession, file: str, separator: str = "\0") -> DataFrame:
    """(path) from a file of paths, such as a version control system lists."""
    return spark.read.text(file, lineSep=separator).select(F.col("value").alias("path")).filter("path <> ''")


def listed(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """The files of a table whose path is in the manifest; for a tree give ``Tree`` the manifest."""
    return corpus.join(manifest.select("path").distinct(), "path", "left_semi")


def missing(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths of the manifest that could not be read: skipped, and counted by the caller."""
    return manifest.select("path").distinct().join(corpus.select("path"), "path", "left_anti")


def distinct_listing(corpus: DataFrame) -> DataFrame:
    return corpus.dropDuplicates(["path"])


def shown_path(path, base: str = ""):
    """A corpus-relative path with an optional prefix for display."""
    return F.concat(F.lit(base.rstrip("/") + "/"), path) if base else path
