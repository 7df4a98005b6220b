"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import impact, ranked, runs

SF = "/root/testdata/sf0.001"


# --- operator 11


def brute_top_k(queries, rows, k=20, scale=64):
    def whole(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    held = [(key, w) for key, v in rows if key is not None and (w := whole(v)) is not None]
    out = []
    for key, v in queries:
        q = whole(v)
        if key is None or q is None:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, w)), other) for other, w in held if other != key and len(w) == len(q))
        out += [(key, rank, other, -score) for rank, (score, other) in enumerate(found[:k], 1)]
    return sorted(out)


def some_vectors(n, d, seed, spread=0.12):
    chance = np.random.default_rng(seed)
    centres = chance.normal(0, spread, (5, d))
    return [(k, [float(np.float32(x)) for x in centres[k % 5] * (k % 3) + chance.normal(0, spread / (1 + k % 4), d)]) for k in range(n)]


@pytest.mark.parametrize(("n", "d", "how"), [(300, 16, impact.Search(k=5, block=32, span=2, queries=7)), (150, 3, impact.Search(k=20, block=64, span=1, queries=64)), (90, 64, impact.Search(k=4, scale=8, block=16, span=3, queries=5))])
def test_top_k_is_exact(spark, n, d, how):
    rows = some_vectors(n, d, n)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = impact.top_k(frame.filter("vec_id % 7 = 0"), frame, how=how).collect()
    assert sorted(map(tuple, got)) == brute_top_k([r for r in rows if r[0] % 7 == 0], rows, how.k, how.scale)


def test_top_k_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, [0.0, 0.0]), (9, [-1.0, -2.0]), (10, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (1, [1.0, 2.0]), (11, [1.0, 2.0]), (20, None), (40, [-0.001, 0.0])]
    schema = "vec_id long, embedding array<float>, at string, key int, d int, span string, part int, role int, score string"
    frame = spark.createDataFrame([(*r, *[None] * 7) for r in rows], schema)
    queries = frame.filter("vec_id % 20 = 0")
    got = impact.top_k(queries, frame, how=impact.Search(k=3, block=2, span=1, queries=1)).collect()
    assert sorted(map(tuple, got)) == brute_top_k([r for r in rows if r[0] is not None and r[0] % 20 == 0], rows, 3)
    assert [r["rank"] for r in got if r["query_id"] == 0] and {r["vec_id"] for r in got if r["query_id"] == 0} == {1, 2}
    for none in (queries, frame):
        assert impact.top_k(none.limit(0), frame).count() == 0 and impact.top_k(frame, frame.limit(0)).count() == 0


def test_a_stop_is_proved():
    """Rows that are left out can't reach the bar, and most are left out before the last level where scores differ."""
    chance = np.random.default_rng(3)
    values = chance.integers(-30, 31, (500, 24))
    values[:20] = 25
    index = impact.Segments(values)
    q = np.full(24, 9)
    rows, scores = impact.possible_rows(index, q, [3], 10, None, 8)
    exact = values @ q
    assert 3 not in rows and (scores == exact[rows]).all() and len(rows) * 8 <= 500
    bar = np.sort(np.delete(exact, 3))[-10]
    assert set(np.flatnonzero(exact >= bar)) - {3} <= set(rows.tolist())


@pytest.mark.parametrize("high", [20, 1 << 19])
def test_queries_of_a_task_are_searched_together(high):
    """One pass over a block for many queries gives each one's k best, with its own rows barred."""
    chance = np.random.default_rng(7)
    values, asked = (chance.normal(0, high / 4, (n, 16)).astype(np.int64).clip(-high, high) for n in (700, 40))
    own = (np.arange(40) * 3, np.arange(40))
    bars = np.where(np.arange(40) % 2, -np.inf, 1.0)
    rows, queries, scores = impact.possible_pairs(impact.Segments(values), asked, own, 9, bars, 4)
    exact = values @ asked.T
    assert (scores == exact[rows, queries]).all() and len(rows) < 0.6 * exact.size
    exact[own] = exact.min() - 1
    for k in range(40):
        best = set(np.flatnonzero(exact[:, k] >= max(np.sort(exact[:, k])[-9], bars[k])).tolist())
        mine = rows[queries == k].tolist()
        assert best <= set(mine) and 3 * k not in mine


def test_op11_on_the_driver_s_rows(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = impact.op11_top_k(spark, SF).collect()
    assert sorted(map(tuple, got)) == brute_top_k([r for r in rows if r[0] % 20 == 0], rows)


# --- operator 12


def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranked.TERM, lowered)


def brute_ranked(items, docs, k=20):
    docs = [(key, terms_of(text)) for key, text in docs if key is not None]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, terms in docs:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        if item is None:
            continue
        asked, found = terms_of(text), []
        for key, terms in docs:
            m = 100 - 25 + (25 * len(terms) * n) // total
            score = 0
            for t in asked:
                tf = terms.count(t)
                if tf:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, key))
        out += [(item, rank, key, -score) for rank, (score, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def some_docs(n, seed):
    chance = random.Random(seed)
    pool = [f"w{k}" for k in range(60)] + ["Über", "naïve", "X1", "x1", "文件"]
    return [(k, chance.choice([" ", "-", "\n", "\0"]).join(chance.choices(pool, [1 / (i + 1) for i in range(len(pool))], k=chance.randrange(0, 90)))) for k in range(n)]


@pytest.mark.parametrize("how", [ranked.Ranking(k=5, block=16, span=2, slice_terms=40), ranked.Ranking(k=20, block=64, span=1), ranked.Ranking(k=3, block=1, span=7)])
def test_ranked_is_exact(spark, how):
    docs, items = some_docs(200, 5), some_docs(25, 6)
    got = ranked.ranked(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3), how=how).collect()
    assert sorted(map(tuple, got)) == brute_ranked(items, docs, how.k)


def test_pieces_of_few_postings(monkeypatch, spark):
    """Blocks that are cut by postings, in one task in this process."""
    docs, items = some_docs(60, 15), some_docs(6, 16)
    want = brute_ranked(items, docs, 20)
    kept = {}

    class Frame:
        """Stands for Spark: gives what is run on batches."""

        schema = {"key": type("K", (), {"dataType": type("D", (), {"simpleString": staticmethod(lambda: "long")})})}

        def __getattr__(self, name):
            return lambda *a, **k: kept.setdefault("run", a[0]) if name == "mapInArrow" else self

    monkeypatch.setattr(ranked, "_POSTINGS", 40)
    terms = sorted({t.encode() for _, text in items for t in terms_of(text)})
    number = {t: k for k, t in enumerate(terms)}
    held = [(k, terms_of(t)) for k, t in docs]
    held = [(k, t) for k, t in held if t]
    n, total = len(held), sum(len(t) for _, t in held)
    df = [sum(t.decode() in set(x) for _, x in held) for t in terms]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df])
    asked = [np.unique(np.array([number[t.encode()] for t in terms_of(text)], np.int64), return_counts=True) for _, text in items]
    ranked._searched(Frame(), asked, weight, n, total, ranked.Ranking())
    own = [[number[t.encode()] for t in sorted(set(x)) if t.encode() in number] for _, x in held]
    counts = [[x.count(terms[k].decode()) for k in o] for o, (_, x) in zip(own, held)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array([k for k, _ in held]), pa.array([len(x) for _, x in held]), pa.array(own, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["span", "key", "n", "terms", "counts"])
    got = [r for b in kept["run"](iter([batch])) for r in b.to_pylist()]
    got = sorted((items[r["item"]][0], r["key"], r["score"]) for r in got)
    assert got == sorted((i, k, s) for i, _, k, s in want)


def test_ranked_on_odd_rows(spark):
    long = "needle " + "straw " * 30000
    docs = [(1, None), (2, ""), (3, " .,; "), (4, "needle in hay"), (5, "needle in hay"), (5, "needle in hay"), (6, "NEEDLE needle"), (None, "needle needle"), (7, long), (8, "hay hay hay"), (9, "né needle_né"), (10, "a" * 5000)]
    items = [(1, "Needle, needle!"), (2, None), (3, "nothing here"), (None, "hay"), (4, "né " + "a" * 5000), (5, ""), (6, "hay")]
    schema = "doc_id long, text string, key int, n string, terms int, counts int, at string, span int, item string, rank int, score int"
    frame = spark.createDataFrame([(*d, *[None] * 9) for d in docs], schema)
    asked = spark.createDataFrame([(*d, *[None] * 2) for d in items], "item_id long, text string, key int, terms int")
    got = ranked.ranked(asked, frame, how=ranked.Ranking(block=4, span=1)).collect()
    assert sorted(map(tuple, got)) == brute_ranked(items, docs)
    assert ranked.ranked(asked, frame.limit(0)).count() == 0 and ranked.ranked(asked.limit(0), frame).count() == 0
    named = ranked.ranked(asked.withColumn("item_id", F.concat(F.lit("i"), "item_id")), frame.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))).collect()
    assert {(r["item_id"], r["rank"]) for r in named} == {(f"i{r['item_id']}", r["rank"]) for r in got}


def test_items_that_repeat_a_key_are_ranked_each(spark):
    docs, items = some_docs(30, 8), [(1, "w1 w2"), (1, "w1 w2"), (1, "w3")]
    got = ranked.ranked(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute_ranked(items, docs))


def test_words_with_a_term_s_hash_are_compared():
    data = np.frombuffer(b"ab cd ab\n", np.uint8)
    known = ranked.Vocabulary([b"ab", b"zz"])
    begin, end, hashes = ranked.tb.words(data, lower=True, marks=True)
    hashes[1] = known.hashes[0]  # as if "cd" had the hash of a term
    at, term = known.found(data, begin, end, hashes)
    assert at.tolist() == [0, 2] and term.tolist() == [0, 0]


# --- operator 13


def brute_runs(x, least=6, times=4):
    n, out = len(x), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j + q - i
            if size >= max(least, times * q) and not any(all(x[i + t] == x[i + t + r] for t in range(size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped_words(chance):
    letters, n, x = chance.choice([1, 2, 3, 8]), chance.randrange(0, 80), []
    while len(x) < n:
        root = [chance.randrange(letters) for _ in range(chance.randrange(1, 9))]
        x += (root * chance.randrange(1, 9))[: chance.randrange(1, 60)]
    return x * chance.choice([1, 1, 1, 3, 5])


def test_runs_are_those_of_brute_force():
    chance = random.Random(11)
    for _ in range(400):
        x = looped_words(chance)
        number = {}
        ids = np.array([number.setdefault(v, len(number)) for v in x], dtype=np.int64)
        assert [tuple(r) for r in runs.runs_of(ids).tolist()] == brute_runs(x), x


def test_a_grammar_derives_its_text_and_repeats_no_pair():
    chance = random.Random(12)
    for _ in range(60):
        ids = np.array([chance.randrange(chance.choice([2, 5, 20])) for _ in range(chance.randrange(2, 200))], dtype=np.int64)
        start, rules = runs.grammar(ids)
        base = int(ids.max()) + 1

        def derived(symbol):
            return [symbol] if symbol < base else derived(rules[symbol - base][0]) + derived(rules[symbol - base][1])

        assert sum(map(derived, start), []) == ids.tolist()
        pairs = [p for p in zip(start, start[1:]) if p[0] != p[1]]
        assert len(pairs) == len(set(pairs))


def test_runs_on_odd_rows(spark):
    chance = random.Random(13)
    texts = [None, "", " \n\t ", "a", "a b " * 40, "x " * 6, "x " * 5, "ü é " * 9 + "tail", "\x1f  a " * 8, ("long " * 3 + "one ") * 9000]
    texts += [" ".join(f"v{v}" for v in looped_words(chance)) for _ in range(20)]
    rows = [(k if k else None, t) for k, t in enumerate(texts)] + [(4, "a b " * 40)]
    schema = "doc_id long, text string, key int, runs string, n_words string, collapsed int"
    got = runs.periodic_runs(spark.createDataFrame([(*r, *[None] * 4) for r in rows], schema).repartition(3)).collect()
    assert len(got) == len(rows)
    held = {}
    for r in got:
        held.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]))
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) > 2000:
            continue
        found = brute_runs(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        assert (len(words), found, " ".join(w for i, w in enumerate(words) if i not in gone)) in held[key]
    assert held[9][0][1] == [(0, 36000, 4)] and held[9][0][2] == "long long long one"
    assert runs.periodic_runs(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], schema), times=2)


def test_op13_on_the_driver_s_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = runs.op13_runs(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    looped = 0
    for row in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[row["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        elif n > 700:
            continue  # brute force takes minutes there
        if n > 1500:
            continue
        found = brute_runs(words)
        looped += bool(found)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert looped >= 5


def test_suspects_keep_every_text_with_a_run():
    chance = random.Random(14)
    for _ in range(100):
        texts = [" ".join(f"v{v}" for v in looped_words(chance)) for _ in range(5)]
        data, starts = runs.tb.joined(pa.array(texts))
        begin, _, hashes = runs.tb.words(data)
        found = set(runs._suspects(np.searchsorted(starts, begin, side="right") - 1, hashes).tolist())
        assert {k for k, t in enumerate(texts) if brute_runs(t.split())} <= found
