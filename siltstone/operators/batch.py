"""Many patterns at once: patterns are a table, and no plan grows with their number.

1. Tasks check the patterns and state them for Java, with the literals that every match contains.
2. Patterns are taken in slices of at most about ``_SLICE`` rows; a slice is known to all tasks.
3. The files that hold the rarest trigram of any of a slice's patterns come from the index; only
   their content is read (of all files, if a pattern has no literal of three bytes).
4. One Aho-Corasick automaton of the slice's literals goes over each line once and gives the (file,
   pattern) pairs with the lines in which all literals of the pattern occur in their order.
5. Each regular expression is compiled once a pair and runs over these lines only. The pairs are dealt out
   anew, so that a file with very many patterns is not the work of one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.files import binary_content
from ..plans.pattern import PatternError, plan, required_literals
from ..shared import checkpointed
from . import postings as P

#: Patterns that tasks know at once, about; patterns of one file that are tested together; and characters of lines in an Arrow batch.
_SLICE, _TOGETHER, _WRITTEN = 20000, 64, 1 << 23


def _lines_of(text: str | None) -> list[str]:
    """The lines of a text, as ``lines`` tells them."""
    body = text.removesuffix("\n") if text else ""
    return body.split("\n") if body else []


def _in_order(line: str, runs: list[str]) -> bool:
    """Whether a line holds the runs one behind the other, as every match does."""
    at = 0
    for r in runs:
        at = line.find(r, at)
        if at < 0:
            return False
        at += len(r)
    return True


def planned(patterns: DataFrame, id: str = "pattern_id", pattern: str = "pattern") -> DataFrame:
    """(pattern_id, java, literals, required) of (id, pattern), checked; a bad pattern raises ``PatternError``."""
    kind = patterns.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("pattern").to_pylist():
                try:
                    query = plan(text)
                    runs = [r.decode() for r in required_literals(text)]
                    rows.append((query.java, runs, list(query.required or ()), None))
                except (PatternError, TypeError) as e:
                    rows.append((None, None, None, f"{text}: {e}"))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("pattern_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["pattern_id", "java", "literals", "required", "error"])

    asked = patterns.select(F.col(id).alias("pattern_id"), F.col(pattern).alias("pattern"))
    out = checkpointed(asked.mapInArrow(run, f"pattern_id {kind}, java string, literals array<string>, required array<int>, error string"))
    if bad := out.filter("error is not null").first():
        raise PatternError(bad["error"])
    try:
        out.agg(F.count_if(F.rlike(F.lit(""), F.col("java")))).collect()
    except (Py4JJavaError, PySparkException) as e:  # Java's own check
        raise PatternError(str(e).split("\n")[0]) from None
    return out.drop("error")


def _rarest(part: DataFrame, stats: DataFrame) -> DataFrame:
    """(tbucket, trigram): each pattern's rarest trigram; patterns with one that no file has are left out."""
    needed = part.select("pattern_id", F.explode("required").alias("trigram")).join(stats.groupBy("trigram").agg(F.sum("df").alias("df")), "trigram", "left")
    least = needed.groupBy("pattern_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "trigram")).alias("r"))
    return least.filter("r.df > 0").select(F.col("r.trigram").alias("trigram"), (F.col("r.trigram") % P.BUCKETS).alias("tbucket")).distinct()


def pairs_in(content: DataFrame, part: DataFrame) -> DataFrame:
    """(file_id, lines, ids, at): lines of (file_id, text), and for some patterns at a time their numbers and the
    places of the lines, among these, that hold all literals of the pattern in order; all lines if it has none."""
    rows = part.select("number", "literals").toArrow()
    needs = dict(zip(rows.column("number").to_pylist(), rows.column("literals").to_pylist(), strict=True))
    kind = content.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        bare = [k for k, runs in needs.items() if not runs]
        # the automaton has one literal of a pattern, the longest; those of one or two bytes are in most lines
        short, users = [], {}
        for k, runs in needs.items():
            r = max(runs, key=len, default="")
            if len(r.encode()) >= 3:
                users.setdefault(r, []).append(k)
            elif r:
                short.append(k)
        known = ahocorasick.Automaton()
        for r, ids in users.items():
            known.add_word(r, (r, ids))
        known.make_automaton()

        def places_of(held: list[str]) -> list[tuple[int, list[int]]]:
            own: dict[int, list[int]] = {k: list(range(len(held))) for k in bare} if held else {}
            for place, line in enumerate(held):
                met = dict(x for _, x in known.iter(line)) if users else {}
                for ids in (short, *met.values()):
                    for k in ids:
                        if _in_order(line, needs[k]):
                            own.setdefault(k, []).append(place)
            return list(own.items())

        def written(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names=["file_id", "lines", "ids", "at"])

        for batch in batches:
            found, size = [], 0
            for row, text in enumerate(batch.column("text").to_pylist()):
                held = _lines_of(text)
                own = places_of(held)
                for k in range(0, len(own), _TOGETHER):
                    numbers, places = zip(*own[k : k + _TOGETHER], strict=True)
                    used = sorted(set().union(*places))
                    new = {place: n for n, place in enumerate(used)}
                    found.append((row, [held[place] for place in used], numbers, [[new[x] for x in some] for some in places]))
                    size += sum(len(held[place]) for place in used) + sum(map(len, places))
                    if size >= _WRITTEN:
                        yield written(batch.column("file_id"), found)
                        found, size = [], 0
            yield written(batch.column("file_id"), found)

    return content.select("file_id", "text").mapInArrow(run, f"file_id {kind}, lines array<string>, ids array<long>, at array<array<int>>")


def batch_table(content: DataFrame, patterns: DataFrame, postings: DataFrame, stats: DataFrame | None = None, files: DataFrame | None = None, id: str = "pattern_id", pattern: str = "pattern", pushed: int = 1000) -> DataFrame:
    """(pattern_id, file_id, n_lines) of a table of patterns; the hits are those of ``search``, pattern by pattern.

    Ids of patterns are unique. ``content`` is (file_id, path, text); content that looks binary, or is not in
    ``files``, has no hits, nor has null content.
    """
    known = planned(patterns, id, pattern)
    stats = P.document_frequency(postings) if stats is None else stats
    n = max(1, -(-known.count() // _SLICE))
    out = None
    for k in range(n):
        part = checkpointed(known.filter(F.pmod(F.xxhash64("pattern_id"), F.lit(n)) == k).withColumn("number", F.monotonically_increasing_id()))
        live = content.filter("text is not null") if files is None else content.filter("text is not null").join(files.select("file_id"), "file_id", "left_semi")
        if part.filter("size(required) = 0").isEmpty():
            # at most a slice of rows
            lists = postings.join(F.broadcast(_rarest(part, stats)), ["tbucket", "trigram"], "left_semi")
            chosen = checkpointed(lists.select(F.explode("ids").alias("file_id")).distinct())
            few = [r[0] for r in chosen.limit(pushed + 1).collect()]
            live = live.join(chosen, "file_id", "left_semi") if len(few) > pushed else live.filter(F.col("file_id").isin(few) if few else F.lit(False))
        pairs = pairs_in(live.filter(~binary_content(F.encode("text", "UTF-8"))), part).hint("rebalance")
        rows = pairs.select("file_id", "lines", F.explode(F.arrays_zip("ids", "at")).alias("p")).select("file_id", F.transform("p.at", lambda x: F.col("lines")[x]).alias("own"), F.col("p.ids").alias("number"))
        rows = rows.join(F.broadcast(part.select("number", F.col("pattern_id").alias(id), "java")), "number")  # at most a slice of rows
        # not rlike, which compiles a column's pattern again for each line; the lines of a pair stay together, so this compiles it
        # once. The outer form has Spark infer no filter that would gather the lines twice; no pair is without lines
        found = rows.select(id, "file_id", "java", F.explode_outer("own").alias("line")).filter(F.regexp_instr("line", F.col("java")) > 0)
        found = found.groupBy(id, "file_id").agg(F.count("*").alias("n_lines"))
        out = found if out is None else out.union(found)
    return out
