"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import attention, lattice, line_dedup, materialise, minhash, mixing, packing, quality_rules, toxicity, url_filter

CLASH = "key string, h int, a int, b int, id string, t int, n int, score string, label string, component int, size int, kept string, w int, text_hash string, n_shingles string, host string, path string, rule string, verdict string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    chance = random.Random(seed)
    return " ".join(chance.choice("abcdefghij") + chance.choice("klmnopqrst") + str(chance.randrange(60)) for _ in range(n))


LONG = "\n".join(words(40, s) for s in range(800))
BASE = words(120, 7)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (1, None, "en", "src1"),
    (2, "", "en", "src1"),
    (3, " \n\t\n ", None, None),
    (4, BASE, "en", "src1"),
    (5, BASE, "en", "src2"),
    (6, NEAR, "de", "src2"),
    (7, LONG, "en", "src1"),
    (8, words(30, 8) + "\n" + words(60, 9) + "\n" + words(10, 10), "fr", "src11"),
    (9, words(20, 11) + "\n" + words(60, 9) + "\n" + words(12, 12), "fr", "src11"),
    (9, words(20, 11) + "\n" + words(60, 9) + "\n" + words(12, 12), "fr", "src11"),
    (9, "another text of the same id", "fr", "src12"),
    (None, words(70, 13), "es", "src3"),
    (None, BASE, "es", "src3"),
    (10, "one two three", "es", "src3"),
    (11, "ONE two  three\n", "es", "src3"),
    (12, "x" * 70000, "en", "src1"),
    (13, "a b " * 400, "en", "src1"),
    (14, "ünï 文件 " + words(60, 14) + " ###$$$", "xx", "src4"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in ROWS], DOCS)
    for part in CLASH.split(", "):
        name, kind = part.split()
        plain = plain.withColumn(name, F.lit(None).cast(kind))
    return plain.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, None), (4, 1, 1), (7, 1, 0), (8, 1, 0), (9, 0, 1), (9, 1, 1), (13, 0, 0), (None, 1, 1), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark, labels):
    return spark.createDataFrame([], labels.schema)


def key(r):
    return tuple((x is None, x) for x in r)


def tokens(text):
    return [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text or "") if w]


# 1 packing
def test_packing(docs, empty):
    how = packing.Packing(packing.tokenizer_path(), window=256, free_every=32, stretch=4096)
    rows = packing.pack(docs, how, with_ids=True).collect()
    from siltstone.llm.tokens import tokenizer

    t = tokenizer(how.tokenizer_path)
    want = sorted(zlib.crc32(np.array([*ids, 1], "<u4").tobytes()) for ids in t._encode([r[1] or "" for r in ROWS]))
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    whole, stream = [], []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            if r["start"] == 0:
                stream.append(b"")
            stream[-1] += bytes(r["ids"])
        assert at <= 256
    whole = sorted(zlib.crc32(x) for x in stream)
    assert whole == want
    assert packing.pack(empty, how).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_cuts_are_the_cheapest(seed):
    chance = random.Random(seed)
    window = 256
    place = sorted({*range(200, 3000, 200), *chance.sample(range(1, 3000), 80)})
    cost = [chance.choice([0, 5, 30]) for _ in place]

    def padding(n):
        return 0 if n & (n - 1) == 0 and n >= 64 else window - n

    best = {0: 0}
    for p, c in zip(place, cost, strict=True):
        best[p] = min(v + padding(p - i) for i, v in best.items() if 0 < p - i <= window) + c
    cuts = packing.cut_windows(np.array(place), np.array(cost), window)
    costs = dict(zip(place, cost, strict=True))
    assert sum(padding(b - a) + costs[b] for a, b in zip([0, *cuts], cuts)) == best[place[-1]]


# 2 line dedup
def brute_lines(rows, least=50):
    """All runs of at least ``least`` words that occur earlier go, by trying every run."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=key)
    seen, gone = {}, {}
    for k, (i, text) in enumerate(docs):
        lines = [x for x in text.split("\n") if tokens(x)]
        for s in range(len(lines)):
            n = 0
            for e in range(s, min(len(lines), s + 60)):
                n += len(tokens(lines[e]))
                if n >= least:
                    run = tuple(lines[s : e + 1])
                    if run in seen:
                        gone.setdefault(k, set()).update(range(s, e + 1))
                    else:
                        seen[run] = True
    out = {}
    for k, (i, text) in enumerate(docs):
        at, kept, some = -1, [], False
        for line in text.split("\n"):
            at += bool(tokens(line))
            if tokens(line) and at in gone.get(k, ()):
                continue
            kept.append(line)
            some |= bool(tokens(line))
        out[(i, text)] = ("\n".join(kept) if some or k not in gone else "", len(gone.get(k, ())))
    return out


def test_lines(spark, docs, empty):
    chance = random.Random(4)
    pool = [words(chance.choice([5, 12, 30, 55]), 100 + k) for k in range(12)]
    rows = [(100 + k, "\n".join(chance.choice([*pool, ""]) for _ in range(chance.randrange(1, 9)))) for k in range(60)]
    rows += [(r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 9] + [(20, LONG)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_lines(rows)
    for r, old in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows), strict=True):
        assert (r["text"], r["n_removed"]) == (want[old] if old[1] is not None else (None, 0)), old[0]
    mixed = line_dedup.drop_repeated_lines(docs)
    assert mixed.count() == len(ROWS) and set(mixed.columns) == {*docs.columns, "n_lines", "n_removed"}
    texts = {(r["doc_id"], r["source"]): r["text"] for r in mixed.filter("doc_id in (4, 5, 8)").collect()}
    assert texts[(4, "src1")] == "" and texts[(5, "src2")] == ""  # the row without an id comes first
    nine = mixed.filter("doc_id = 9 and source = 'src11'").collect()
    assert [r["n_removed"] for r in nine] == [1, 1]  # repeated rows are treated alike
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_a_line_that_all_texts_share(spark):
    chance = random.Random(14)
    common, long_line, block = "a line that all texts share", words(55, 3), "\n".join(words(9, 40 + k) for k in range(7))
    rows = []
    for k in range(400):
        parts = [common, *(words(chance.randrange(1, 20), 5000 + 10 * k + j) for j in range(chance.randrange(0, 4)))]
        parts += [block] if k % 3 == 0 else []
        parts += [long_line] if k % 5 == 0 else []
        chance.shuffle(parts)
        rows.append((k, "\n".join([common, *parts])))
    rows += [(1000 + k, "\n".join(["w"] * 120)) for k in range(3)]  # runs that overlap themselves
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = brute_lines(rows)
    for r, old in zip(sorted(got, key=lambda r: r["doc_id"]), sorted(rows), strict=True):
        assert (r["text"], r["n_removed"]) == want[old], old[0]


# 3 URL filter
URLS = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/1", "ftp://notexample.com/en/", "http://example.com/de/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://a://b/c", "http://com.", "x://é.com/ü?q", "http://example.com?en/", "http://x.org/" + "p" * 5000]


def brute_url(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    import re

    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, default)


def test_urls(spark):
    chance = random.Random(2)
    rules = url_filter.RULES + [(f"h{k}.example.org", f"/{chance.choice('abc')}/", chance.choice(["allow", "block"])) for k in range(50)]
    urls = URLS + [f"http://{chance.choice(['', 'www.'])}h{chance.randrange(60)}.example.org/{chance.choice('abc')}/{k}" for k in range(100)]
    pages = spark.createDataFrame([(k, u, "x", 1) for k, u in enumerate(urls)] + [(0, urls[4], "x", 1), (None, urls[4], "x", 1)], "page_id long, url string, host string, row int")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("", "/", "block"), ("x", None, "block"), ("com", "en/", "block"), ("net", "/fr/", None)], "host string, path string, verdict string")
    got = url_filter.judge_urls(pages, listed).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        if r["page_id"]:
            assert tuple(r)[1:] == brute_url(urls[r["page_id"]], rules), urls[r["page_id"]]
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}


def test_splits_of_one_string_are_told_apart(spark):
    rules = spark.createDataFrame([("ab", "/", "block"), ("a", "b/", "allow"), ("AB", "/", "allow"), ("c", "", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "x://ab/"), (2, "x://a/b/"), (3, "x://z.c"), (4, "x://c/q")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, default="none").collect()}
    assert got == {1: ("ab/", "block"), 2: (None, "none"), 3: ("c", "block"), 4: ("c", "block")}


def test_equal_digests_are_told_apart(spark, tmp_path, monkeypatch):
    """Many rules, a few digests, several shards; with few digests each has very many strings."""
    monkeypatch.setattr(url_filter, "_digest", lambda text: (F.length(text) % 5).cast("long"))
    monkeypatch.setattr(url_filter, "_digests", lambda texts: np.array([len(t.decode()) % 5 for t in texts]))
    rules = [(f"h{k}.com", "/", k % 2 == 1) for k in range(300)]
    least, files = url_filter.write_array(spark.createDataFrame(rules, "host string, path string, blocked boolean"), f"file://{tmp_path}/rules")
    got = url_filter._verdicts([*((h, "/p") for h, _, _ in rules), ("h9999.com", "/"), ("", "")], np.array(least), files, "none")
    assert got == [(h + p, "block" if v else "allow") for h, p, v in rules] + [(None, "none")] * 2


def many_shards(spark, tmp_path, rules, n):
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # else partitions as small as these become one
    spark.conf.set(merging, "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        return url_filter.write_array(rules, f"file://{tmp_path}/rules")
    finally:
        spark.conf.unset(merging)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_many_rules_make_many_shards_that_are_opened_once(spark, tmp_path, monkeypatch):
    rules = spark.range(20000).selectExpr("concat('h', id, '.com') as host", "concat('/', repeat('x', cast(id % 400 as int)), '/') as path", "id % 3 = 0 as blocked")
    least, files = many_shards(spark, tmp_path, rules, 64)
    assert len(files) > 50 and least == sorted(least)
    assert sum(len(url_filter.Shard(f).keys) for f in files) == 40000  # rules and hosts
    opened, asked = {}, []
    shard, found = url_filter.Shard, url_filter._found

    def counting(file):
        opened[file] = opened.get(file, 0) + 1
        return shard(file)

    def counted(texts, *rest):
        asked.append(len(texts))
        return found(texts, *rest)

    monkeypatch.setattr(url_filter, "Shard", counting)
    monkeypatch.setattr(url_filter, "_found", counted)
    urls = [(k, f"www.h{k}.com", "/" + "x" * (k % 400) + "/" + "y" * 300) for k in range(0, 20000, 7)]
    batches = [pa.RecordBatch.from_pydict({"key": [u[0] for u in part], "host": [u[1] for u in part], "path": [u[2] for u in part]}) for part in (urls[:1000], urls[1000:2000], urls[2000:])]
    out = [r for b in url_filter._judged(iter(batches), np.array(least), files, "allow") for r in b.to_pylist()]
    assert [r["key"] for r in out] == [k for k, *_ in urls]
    assert all((r["verdict"] == "block") == (r["key"] % 3 == 0) and r["rule"] is not None for r in out)
    assert set(opened) == set(files) and max(opened.values()) <= 2  # for all batches together: once for hosts, once for rules
    assert asked[1] == len(urls)  # of 400 lengths each host has one


def test_shards_are_deleted_after_use(spark):
    import os

    base = url_filter.shared_dir(spark).removeprefix("file://")
    pages = spark.createDataFrame([(1, "x://example.com/en/")], "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string"))
    assert not [n for n in os.listdir(base) if n.startswith("url-rules-")] and got.first()["rule"] == "example.com/en/"


# 4 quality rules
def brute_features(text):
    w = tokens(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if tokens(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_features(docs, empty, labels, no_labels):
    got = quality_rules.features(docs.filter("doc_id is null or doc_id <> 7")).select("text", *quality_rules.FEATURES).collect()
    for r in got:
        assert tuple(r)[1:] == brute_features(r["text"])
    for some in (labels, no_labels):
        out = quality_rules.judge(docs, some).collect()
        assert len(out) == len(ROWS)
        assert all(not r["kept"] for r in out if r["base_failed"]) and any(r["kept"] for r in out)
    assert quality_rules.judge(empty, labels).count() == 0


def test_binomial_tail(spark):
    from math import comb

    cases = [(n, k) for n in (1, 5, 40, 300, 2000) for k in {0, 1, n // 60, n // 41}]
    df = spark.createDataFrame(cases, "n long, k long")
    for r in df.withColumn("p", quality_rules._binomial_tail(F.col("n"), F.col("k"), 0.025)).collect():
        n, k = r["n"], r["k"]
        want = 1.0 if k >= n * 0.025 else sum(comb(n, j) * 0.025**j * 0.975 ** (n - j) for j in range(k + 1))
        assert r["p"] == pytest.approx(want, rel=1e-9)
    big = spark.createDataFrame([(10**9, 24_900_000)], "n long, k long").select(quality_rules._binomial_tail(F.col("n"), F.col("k"), 0.025).alias("p")).first()["p"]
    assert 0 < big < 1e-80


def test_cutoffs_stop_at_the_first_unsafe(spark):
    good = [(i, "en", 1000, 5000, 0 if i >= 30 else 400, 0, 1) for i in range(2000)]
    rows = [(*g[:5], 0, 0, 1) for g in good]
    df = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality int")
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality_rules.calibrate(df, quality_rules.RiskRules(), "lang").collect()}
    # 30 of 2000 good documents have 8 % symbols: 1.5 % is safe at 2.5 %; at 1 % it is not
    assert got == {("en", "symbols"): 1, ("en", "repeats"): 20}
    strict = quality_rules.RiskRules(alpha=0.02)
    got = {(r["stratum"], r["rule"]): r["cutoff"] for r in quality_rules.calibrate(df, strict, "lang").collect()}
    assert got == {("en", "symbols"): 10, ("en", "repeats"): 20}


# 5 toxicity and 7 quality classifier
@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (attention, "quality")])
def test_scores(docs, empty, labels, no_labels, module, label):
    for some in (labels, no_labels):
        model = module.train(docs, some, label=label)
        out = module.score(docs, model).collect()
        assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
        assert len({round(r["score"], 12) for r in out if r["doc_id"] in (1, 2, 3)}) == 1
    assert module.score(empty, model).count() == 0
    assert module.train(empty, labels, label=label)


def test_one_class_of_labels(spark, docs):
    for module, label in ((toxicity, "toxic"), (attention, "quality")):
        for value in (0, 1):
            marks = spark.createDataFrame([(k, value) for k in range(1, 13)], f"doc_id long, {label} int")
            scores = [r["score"] for r in module.score(docs, module.train(docs, marks, label=label)).collect()]
            assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
            # texts that are all toxic tell nothing of what makes them so: toxicity calls every text harmless
            assert np.mean(scores) < 0.1 if value == 0 or module is toxicity else np.mean(scores) > 0.9


def test_a_key_with_very_many_texts_is_one_training_row(spark):
    from siltstone.llm import labelled

    rows = [(k % 3 if k < 300 else k, f"text {k}") for k in range(400)] + [(500, None), (500, None), (None, "x")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, label int, __text string")
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(600), 1, 2]] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = labelled.training_rows(docs, labels, "quality", "doc_id", "text", 1000)
    kept = {k for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 5}
    assert got.columns == ["text", "label"] and got.count() == len(kept)
    assert labelled.training_rows(docs, labels, "quality", "doc_id", "text", 20).count() <= 20
    again = labelled.training_rows(docs.repartition(5), labels, "quality", "doc_id", "text", 1000)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_null_keys_spread_over_the_mix(spark):
    rows = [(None, f"w{k} " * 5, "en", "src1") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.select_mix(docs, mixing.Mix(levels=("source",), weights={}, budget_percent=50, max_epochs=1)).collect()
    assert len(taken) == 200 and {r["copies"] for r in taken} == {1}


def test_attention_scores_by_plain_loops():
    """A score word by word and passage by passage; and no score depends on the texts beside it."""
    import math

    texts = ["One two, two THREE! 42 #x\nfour five five-six é; " * 9, "again again again", "the end. of it", "again " * 70]
    chance = np.random.default_rng(12)
    how, style = attention.Attention(passage_words=16, encoded=5, gate=3), attention._STYLE
    shapes = {"mean": style, "E": (style, 5), "W": (attention._WORDS, 5), "e": 5, "V": (5, 3), "U": (5, 3), "w": 3, "c": 5, "b": 1}
    m = {k: chance.normal(size=v) * 0.5 for k, v in shapes.items()} | {"spread": chance.random(style) + 0.5}
    kinds = [b"#*$%&|<>@^~_=+\\/{}[]", b".!?", b",;:'\"()-", b"0123456789", bytes(range(65, 91)), bytes(range(0xC0, 256)), b"\n"]
    x, at = attention._passages(pa.array(texts), how.passage_words)
    got = attention._forward(m, x, at)["y"]
    for k, text in enumerate(texts):
        data, spans = text.encode(), [s.span() for s in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
        words = [data[a:b] for a, b in spans]
        lowered, encoded = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words], []
        repeated = [any(i >= lag and lowered[i] == lowered[i - lag] for lag in range(1, 9)) for i in range(len(words))]
        bucket = [int(h) % attention._WORDS for h in attention.tb.words(np.frombuffer(data + b"\n", np.uint8), lower=True)[2]]
        for first in range(0, len(words), how.passage_words):
            own = range(first, min(first + how.passage_words, len(words)))
            part = data[spans[own[0]][0] : spans[own[-1]][1]]
            sizes = [len(words[i]) for i in own]
            mean = sum(sizes) / len(own)
            look = [math.sqrt(sum(c in kind for c in part) / len(part)) for kind in kinds]
            look += [math.log1p(len(own)), mean, math.sqrt(sum((n - mean) ** 2 for n in sizes) / len(own)), sum(n <= 4 for n in sizes) / len(own)]
            look += [sum(i > 0 and lowered[i] == lowered[i - 1] for i in own) / len(own), sum(repeated[i] for i in own) / len(own), sum(words[i][-1] in kinds[0] + kinds[1] + kinds[2] for i in own) / len(own)]
            look = [(v - a) / b for v, a, b in zip(look, m["mean"], m["spread"], strict=True)]
            encoded.append([math.tanh(sum(v * m["E"][j][d] for j, v in enumerate(look)) + sum(m["W"][bucket[i]][d] for i in own) / len(own) + m["e"][d]) for d in range(5)])
        gated = []
        for h in encoded:
            t = [math.tanh(sum(h[d] * m["V"][d][g] for d in range(5))) for g in range(3)]
            u = [1 / (1 + math.exp(-sum(h[d] * m["U"][d][g] for d in range(5)))) for g in range(3)]
            gated.append(math.exp(sum(a * b * c for a, b, c in zip(t, u, m["w"], strict=True))))
        pooled = [sum(g * h[d] for g, h in zip(gated, encoded, strict=True)) / sum(gated) for d in range(5)]
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(pooled, m["c"], strict=True)) + m["b"][0]))), rel=1e-6)
        alone, bounds = attention._passages(pa.array([text]), how.passage_words)
        assert attention._forward(m, alone, bounds)["y"][0] == pytest.approx(got[k], rel=1e-9)


def test_training_order_is_the_feistel_order_written_out():
    """The permutation in plain whole numbers: rounds on two halves, again until the value is below n."""
    wide = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & wide
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & wide
        return x ^ (x >> 31)

    for n, key in ((1, 3), (2, 1), (37, 5), (1000, (7 << 32) + 11), (4096, 2**40)):
        half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        rounds = [mix((j + (key & 0xFFFFFFFF) * (1 << 32)) * 0x9E3779B97F4A7C15 & wide) ^ (key >> 32) for j in range(1, 7)]
        want = []
        for x in range(n):
            while True:
                left, right = x >> half, x & ((1 << half) - 1)
                for k in rounds:
                    left, right = right, left ^ (mix((right + k) & wide) & ((1 << half) - 1))
                x = (left << half) | right
                if x < n:
                    break
            want.append(x)
        assert materialise.feistel(np.arange(n), n, key).tolist() == want and sorted(want) == list(range(n))


def some_passages(chance, n):
    words_each = chance.integers(1, 6, n)
    return attention.Passages(chance.normal(size=(n, attention._STYLE)), chance.integers(0, 50, words_each.sum()), np.append(0, np.cumsum(words_each)))


def test_attention_slopes_are_those_of_its_loss():
    chance = np.random.default_rng(4)
    size = {"E": (attention._STYLE, 5), "W": (50, 5), "e": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "b": (1,)}
    m = {k: chance.normal(size=v) * 0.5 for k, v in size.items()} | {"mean": np.zeros(attention._STYLE), "spread": np.ones(attention._STYLE)}
    x, at, labels = some_passages(chance, 9), np.array([0, 2, 3, 9]), np.array([1, 0, 1])

    def loss():
        y = attention._forward(m, x, at)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for name, slope in attention._slopes(m, x, at, labels).items():
        for k in chance.integers(0, m[name].size, 12):
            place, old = np.unravel_index(k, m[name].shape), m[name].flat[k]
            m[name].flat[k] = old + 1e-6
            up = loss()
            m[name].flat[k] = old - 1e-6
            down = loss()
            m[name].flat[k] = old
            assert slope[place] == pytest.approx((up - down) / 2e-6, abs=1e-7), name


@pytest.mark.parametrize("style", [True, False])
def test_quality_of_unseen_documents(spark, style):
    """A bad passage hides somewhere in a bad document; what is bad are its words."""
    chance = random.Random(5)
    rows, marks = [], []
    for k in range(700):
        parts = [words(64, 50_000 + 20 * k + j) for j in range(chance.randrange(1, 5))]
        good = chance.random() < 0.6
        if not good:
            parts[chance.randrange(len(parts))] = " ".join(chance.choice(["cheap", "click", "winner", "prize", "offer"]) if chance.random() < 0.5 else w for w in parts[0].split())
        rows.append((k, " ".join(parts), "x"))
        marks.append((k, int(good)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(marks, "doc_id long, quality int")
    how = attention.Attention(style=style)
    out = {r["doc_id"]: r["score"] for r in attention.score(docs, attention.train(docs, labels, how), how).collect()}
    held = [k for k, _ in marks if zlib.crc32(str(k).encode()) % 5 == 0]
    truth = dict(marks)
    assert sum((out[k] >= 0.5) == bool(truth[k]) for k in held) >= 0.95 * len(held)


def test_noisy_or_is_one_minus_the_product(spark):
    texts = ["one two. three four! five\nsix", "seven", "", None, "a b c. d e f. " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weight = np.random.default_rng(6).normal(size=toxicity._BUCKETS + 1).astype(np.float32)
    weight[-1] = -2
    model = weight.tobytes()
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    each = {}
    for r in toxicity.offending_sentences(docs, model, at_least=0.0).collect():
        each.setdefault(r["doc_id"], []).append(r["score"])
    assert [len(each.get(k, [])) for k in range(5)] == [4, 1, 0, 0, 100]
    for k, some in each.items():
        assert out[k]["score"] == pytest.approx(1 - np.prod([1 - p for p in some]), abs=1e-9)
        assert some[out[k]["worst_sentence"]] == max(some) if k < 4 else True
    pull = 1 / (1 + np.exp(2))
    assert out[2]["score"] == pytest.approx(pull) and out[3]["score"] == pytest.approx(pull)


def test_offending_sentences(spark):
    chance = random.Random(1)
    rows, marks = [], []
    for k in range(600):
        parts = [words(8, 10_000 + 20 * k + j) for j in range(6)]
        bad = chance.random() < 0.3
        if bad:
            parts[3] = parts[3] + " vile" + chance.choice(["", "ness", "ly"]) + " " + words(2, k)
        rows.append((k, ". ".join(parts) + ".", None))
        marks.append((k, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, key string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    held = {k for k, _ in marks if zlib.crc32(str(k).encode()) % 5 == 0}
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = dict(marks)
    assert sum((out[k]["score"] >= 0.5) == bool(truth[k]) for k in held) >= 0.97 * len(held)
    found = toxicity.offending_sentences(docs, model).collect()
    texts = {r[0]: r[1].encode() for r in rows}
    assert all(r["sentence"] == 3 and b"vile" in texts[r["doc_id"]][r["start"] : r["end"]] for r in found) and len({r["doc_id"] for r in found}) >= 0.9 * sum(truth.values())


# 6 training order
def test_training_order(spark, docs, empty, tmp_path):
    how = materialise.Order(packing.tokenizer_path(), length=64, shard_bytes=64 * 2 * 10)
    rows = materialise.materialise(docs, f"file://{tmp_path}/o", how).collect()
    n = len(rows)
    assert sorted(r["index"] for r in rows) == sorted(r["slot"] for r in rows) == list(range(n)) and n > 30
    assert [int(materialise.feistel(np.array([r["index"]]), n, how.key)[0]) for r in rows] == [r["slot"] for r in rows]
    by_slot = {r["slot"]: r for r in rows}
    read = list(materialise.read_from(f"file://{tmp_path}/o"))
    assert [zlib.crc32(x.tobytes()) for x in read] == [by_slot[s]["crc32"] for s in range(n)]
    assert [x.tobytes() for x in materialise.read_from(f"file://{tmp_path}/o", 17)] == [x.tobytes() for x in read[17:]]
    from siltstone.llm.tokens import tokenizer

    ids = sorted(i for x in tokenizer(how.tokenizer_path)._encode([r[1] or "" for r in ROWS]) for i in [*x, 1])
    assert sorted(int(i) for s, x in enumerate(read) for i in x[: by_slot[s]["n_tokens"]]) == ids
    assert materialise.materialise(empty, f"file://{tmp_path}/e", how).count() == 0
    for n in (1, 2, 3, 5, 1000):
        assert sorted(materialise.feistel(np.arange(n), n, 9).tolist()) == list(range(n))


# 8 mixing
def fill(children, budget):
    """Deal to (name, weight, capacity) in proportion, whole numbers, by raising the level."""
    out, rest, left = {}, budget, sorted(children, key=lambda c: (c[2] / c[1], c[0]))
    while left:
        total = sum(c[1] for c in left)
        name, weight, cap = left[0]
        if cap * total <= weight * rest:
            out[name], rest, left = cap, rest - cap, left[1:]
        else:
            return out | {n: w * rest // total for n, w, _ in left}
    return out


def test_mix(spark, docs, empty):
    chance = random.Random(3)
    rows = [(k, words(chance.randrange(1, 40), k), chance.choice(["en", "en", "de", None]), chance.choice(["src1", "src1", "src12", "src3"]), 0) for k in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    mix = mixing.Mix(budget_percent=130, max_epochs=3)
    got = mixing.select_mix(df, mix, domain=mixing.web_or_curated(F.col("source"))).collect()
    size = {}
    for k, text, lang, source, _ in rows:
        leaf = ("curated" if source == "src12" else "web", lang or "", source)
        size[leaf] = size.get(leaf, 0) + len(tokens(text))
    budget = {(): sum(size.values()) * 130 // 100}
    for depth, level in enumerate(mix.levels):
        for parent in {x[:depth] for x in size}:
            names = {x[depth] for x in size if x[:depth] == parent}
            caps = [(n, mix.weights.get(level, {}).get(n, 1), 3 * sum(v for x, v in size.items() if x[: depth + 1] == (*parent, n))) for n in names]
            budget |= {(*parent, n): b for n, b in fill(caps, budget[parent]).items()}
    used = {}
    for r in got:
        leaf = (r["domain"], r["lang"], r["source"])
        used[leaf] = used.get(leaf, 0) + r["n_tokens"] * r["copies"]
    for leaf, n in size.items():
        assert budget[leaf] - 40 < used.get(leaf, 0) <= budget[leaf]
    again = mixing.select_mix(df.repartition(7), mix, domain=mixing.web_or_curated(F.col("source"))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    odd = mixing.select_mix(docs, mixing.Mix(budget_percent=500, max_epochs=1), domain=mixing.web_or_curated(F.col("source")))
    assert odd.agg(F.sum("n_tokens")).first()[0] == sum(len(tokens(r[1])) for r in ROWS)
    assert mixing.select_mix(empty, mixing.Mix(), domain=mixing.web_or_curated(F.col("source"))).count() == 0


# 9 MinHash
def brute_components(sets, least=80):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= least * len(a | b):
                p, q = sorted((root(ids[x]), root(ids[y])))
                parent[q] = p
    return {i: root(i) for i in ids}


def shingles(text, width):
    w = ["".join(c.lower() if c.isascii() else c for c in x) for x in tokens(text)]
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width):
    chance = random.Random(6)
    rows = []
    for g in range(25):
        base = words(chance.choice([3, 20, 80, 200]), 500 + g).split()
        for c in range(chance.randrange(1, 9)):
            copy = list(base)
            for _ in range(chance.randrange(0, 4)):
                copy[chance.randrange(len(copy))] = f"new{g}{c}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 9]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    want = brute_components({k: shingles(t, width) for k, t in rows})
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {k: len(shingles(t, width)) for k, t in rows}


def test_near_duplicates_odd_rows(docs, empty):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["component_id"] for r in got if r["doc_id"] in (4, 5)} == {4}
    assert all(r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert minhash.near_duplicates(empty).count() == 0


def test_star_of_copies_without_links_among_them(spark):
    """Many copies with edits of their own: linked to the base or to nothing."""
    chance = random.Random(8)
    base = words(150, 1).split()
    rows = [(50, " ".join(base))]
    for c in range(60):
        copy = list(base)
        for k in range(chance.choice([2, 3, 6, 12])):
            copy[chance.randrange(len(copy))] = f"own{c}x{k}"
        rows.append((c if c < 50 else c + 1, " ".join(copy)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components({k: shingles(t, 4) for k, t in rows})


def test_a_large_group_among_many_rows(spark):
    """20,000 rows, 2,000 of them near copies of one text; ids divisible by 20 against all rows."""
    chance = random.Random(18)
    base = words(120, 77).split()
    rows = []
    for k in range(20_000):
        if k % 10 == 0:
            copy = list(base)
            for _ in range(chance.choice([0, 1, 2, 4, 8, 12])):
                at = chance.randrange(len(copy))
                copy[at : at + 1] = chance.choice([[], [f"n{chance.randrange(40)}"], [copy[at], "and"]])
            rows.append((k, " ".join(copy)))
        elif k % 10 == 4:
            rows.append((k, words(30, k // 200)))
        else:
            rows.append((k, words(chance.randrange(5, 60), 100_000 + k)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=4).collect()}
    sets = {k: frozenset(shingles(t, 4)) for k, t in rows}
    by_size, links, found = {}, 0, 0
    for k, s in sets.items():
        by_size.setdefault(len(s), []).append(k)
    for q in range(0, 20_000, 20):
        n = len(sets[q])
        for size in range(-(-n * 4 // 5), n * 5 // 4 + 1):
            for o in by_size.get(size, ()):
                if o != q and 180 * len(sets[q] & sets[o]) >= 80 * (n + size):
                    links += 1
                    found += got[q] == got[o]
    assert links > 1000 and found >= 0.99 * links
    assert all(got[k] == k for k in range(20_000) if k % 10 not in (0, 4))


def test_pages_of_one_template_meet_few_others(spark, monkeypatch):
    """Pages that differ in six slots: three of six must agree for a link, and only few other pairs are written."""
    chance = random.Random(4)
    base, slots = [f"w{chance.randrange(10**6)}" for _ in range(120)], [10, 30, 50, 70, 90, 110]
    fills = np.array([[chance.randrange(30) for _ in slots] for _ in range(600)])
    rows = []
    for k, own in enumerate(fills):
        page = list(base)
        for at, v in zip(slots, own):
            page[at] = f"fill{at}x{v}"
        rows.append((k, " ".join(page)))
    links = [(i, int(j)) for i in range(len(fills)) for j in np.flatnonzero((fills[i + 1 :] == fills[i]).sum(axis=1) >= 3) + i + 1]
    pairs, inner = [], minhash.prefix_candidates

    def counted(*args):
        out = minhash.checkpointed(inner(*args))
        pairs.append(out.count())
        return out

    monkeypatch.setattr(minhash, "prefix_candidates", counted)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    least = list(range(len(fills)))
    for _ in range(len(fills)):
        before = list(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    assert len(links) > 50 and pairs[0] <= 10 * len(links)
    assert sum(got[k] == least[k] for k in got) >= 0.99 * len(got)


@pytest.mark.parametrize("carried", [64, 2])
def test_a_pair_is_written_at_its_first_common_item(spark, monkeypatch, carried):
    """Sets with many items in common meet once, not once an item; with few items carried no link is lost either."""
    chance = np.random.default_rng(5)
    base, pool = chance.integers(0, 1 << 62, 100).astype(np.uint64), chance.integers(0, 1 << 62, 30).astype(np.uint64)
    found = [np.unique(np.concatenate([base[np.sort(chance.choice(100, 92, replace=False))], chance.choice(pool, 8 + k % 3, replace=False)])) for k in range(60)]
    rows = [(k, 1, len(x), x.view(np.int64).tolist(), *minhash._parities(x).tolist()) for k, x in enumerate(found)]
    sets = spark.createDataFrame(rows, "id long, h long, n long, items array<long>, " + ", ".join(f"{s} long" for s in minhash._PARITY))
    component = spark.createDataFrame([(k, k - k % 2) for k in range(60)], "id long, c long")
    monkeypatch.setattr(minhash, "_CARRIED", carried)
    met = [tuple(r) for r in minhash.prefix_meetings(sets, component, 80).collect()]
    links = {(a, b) for b in range(60) for a in range(b - b % 2) if 180 * len(np.intersect1d(found[a], found[b])) >= 80 * (len(found[a]) + len(found[b]))}
    assert len(links) > 50 and links <= set(met)
    assert len(met) == len(set(met)) or carried == 2


def test_parities_differ_in_no_more_places_than_items():
    chance = np.random.default_rng(8)
    for n in (1, 40, 300, 5000):
        one = np.unique(chance.integers(0, 1 << 63, n).astype(np.uint64))
        for change in (0, 1, 7, n):
            other = np.unique(np.concatenate([one[min(change, len(one)) :], chance.integers(0, 1 << 63, change).astype(np.uint64)]))
            differ = sum(int(x).bit_count() for x in (minhash._parities(one) ^ minhash._parities(other)).view(np.uint64))
            assert differ <= len(np.setxor1d(one, other))


# 10 embeddings
def test_lattice(spark):
    chance = np.random.default_rng(2)
    rows, k = [], 0
    for g in range(30):
        centre = chance.normal(size=16)
        for _ in range(chance.integers(1, 8)):
            rows.append((k, (centre + chance.normal(size=16) * 0.2).tolist(), 1))
            k += 1
    rows += [(k, rows[0][1], 1), (k + 1, [2 * x for x in rows[0][1]], 1), (k + 2, None, 1), (k + 3, [], 1), (k + 4, [0.0] * 16, 1), (k + 5, [float("nan")] + [1.0] * 15, 1), (k + 6, [None] + [1.0] * 15, 1), (k + 7, [float("inf")] + [1.0] * 15, 1), (k + 8, [1.0, 2.0], 1), (k + 9, [1e300] * 16, 1)]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame([*rows, (None, rows[0][1], 1)], "vec_id long, embedding array<double>, id int"), how=lattice.Lattice(block=16)).collect() if r["vec_id"] is not None}
    good = [(i, np.array(v, dtype=float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, *_ in rows}
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and (a / abs(a).max()) @ (b / abs(b).max()) / np.linalg.norm(a / abs(a).max()) / np.linalg.norm(b / abs(b).max()) >= 0.9:
                links[i].add(j)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * sum(map(len, links.values())) and all(got[i]["n_links"] <= len(links[i]) for i in links)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    assert sum(got[i]["component_id"] == reach(i) for i in links) >= 0.99 * len(links)
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_one_key_are_judged_each(spark):
    a, b, c, far = ([1.0, x, 0.0, 0.0] for x in (0.0, 0.01, 0.02, 0.0))
    far = [0.0, 0.0, 1.0, 0.0]
    frame = spark.createDataFrame([(1, a), (1, b), (2, c), (3, far), (1, far), (4, far)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, lattice.near_vectors(frame).collect()))
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (1, 2, 1, True), (4, 2, 1, False)])
    frame = spark.createDataFrame([("x", a), ("x", b), ("w", c), ("y", far)], "vec_id string, embedding array<double>")
    got = sorted(map(tuple, lattice.near_vectors(frame).collect()))
    assert got == [("w", 2, "w", True), ("x", 2, "w", False), ("x", 2, "w", False), ("y", 0, "y", True)]
    two = spark.createDataFrame([(1, a), (1, b)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, lattice.near_vectors(two).collect())) == [(1, 1, 1, True)] * 2


@pytest.mark.parametrize("block", [2048, 50])
def test_separated_vectors_are_exact(spark, block):
    """Tight groups, from one vector to 300: in pairs, in a matrix, and across blocks."""
    chance = np.random.default_rng(9)
    rows, group = [], []
    for g, n in enumerate([1, 2, 3, 5, 64, 65, 70, 300] + [1] * 60):
        centre = chance.normal(size=32)
        for _ in range(n):
            rows.append((len(rows), (centre + chance.normal(size=32) * 0.03).tolist()))
            group.append(g)
    rows.append((len(rows), rows[10][1]))  # an exact copy
    group.append(group[10])
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), how=lattice.Lattice(block=block)).collect()}
    for k, g in enumerate(group):
        assert (got[k]["n_links"], got[k]["component_id"]) == (group.count(g) - 1, group.index(g)), k


def test_e8_decoding_is_nearest():
    chance = np.random.default_rng(5)
    steps = lattice.shortest_steps()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    points = chance.normal(size=(2000, 8)) * 2
    cells = lattice.decode_e8(points)
    distance = ((points - cells) ** 2).sum(axis=1)
    assert (distance <= 1 + 1e-9).all()
    # no neighbour of the decoded point is nearer, which for E8 makes it the nearest
    assert (distance[:, None] <= ((points[:, None] - cells[:, None] - steps[None]) ** 2).sum(axis=2) + 1e-9).all()


# the pipeline
def test_stages(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (plain, plain.limit(0)):
        now = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}-{table is plain}")
            now = spark.read.parquet(f"{tmp_path}/{k}-{table is plain}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == plain.columns
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
