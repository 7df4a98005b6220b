"""Each stage of the pipeline against a brute-force version, on what the stage before it kept."""

import random
import zlib
from math import comb

import numpy as np
import pytest
from test_edges import DOCS, brute_components, brute_features, brute_lines, fill, shingles, tokens, words

import corpus_pipeline
from siltstone.llm.packing import tokenizer_path
from siltstone.llm.tokens import tokenizer


def is_good(text):
    return "spam" not in (text or "") and "#" not in (text or "")


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Rows of the documents and of each stage."""
    base = tmp_path_factory.mktemp("pipeline")
    chance = random.Random(12)
    shared = [words(60, 900 + k) for k in range(4)]
    rows = []
    for k in range(450):
        parts = [words(chance.randrange(5, 40), 2000 + k + 1000 * j) for j in range(chance.randrange(1, 6))]
        if k % 9 == 0:
            parts.insert(chance.randrange(len(parts) + 1), chance.choice(shared))
        if k % 17 == 0:
            parts.append("spam " * chance.choice([20, 200]))
        if k % 23 == 0:
            parts.append("# $ % " * 5)
        text = "\n".join(parts)
        if k % 7 == 3 and tokens(rows[-1][1]):
            text = rows[-1][1].replace(tokens(rows[-1][1])[0], "other", 1)
        if k % 31 == 5:
            text = rows[-2][1]
        rows.append((k, None if k == 77 else text, chance.choice(["en"] * 5 + ["de", "fr", None]), chance.choice(["src0", "src0", "src3", "src12"]), 0))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, int(is_good(text)), 0) for k, text, *_ in rows[:420]], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    out = [spark.read.parquet(f"{base}/documents.parquet").collect()]
    now = spark.read.parquet(f"{base}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(base)).write.parquet(f"{base}/{name}")
        now = spark.read.parquet(f"{base}/{name}")
        out.append(now.collect())
    whole = corpus_pipeline.run(spark, str(base)).collect()
    return out, whole


def test_quality(outputs):
    docs, kept = outputs[0][:2]
    found = {r["doc_id"]: brute_features(r["text"]) for r in docs}
    strata = {r["doc_id"]: r["lang"] for r in docs}
    ratio = {"symbols": lambda f: (f[2], f[1]), "repeats": lambda f: (f[4], f[0])}
    cutoffs = {"symbols": [20, 10, 5, 2, 1], "repeats": [45, 40, 35, 30, 25, 20]}
    good = {}
    for r in docs:
        if r["doc_id"] < 420 and is_good(r["text"]):
            good.setdefault(r["lang"], []).append(found[r["doc_id"]])
    certified = {}
    for lang, some in good.items():
        for rule, steps in cutoffs.items():
            for cut in steps:
                bad = sum(100 * a > cut * b for a, b in map(ratio[rule], some))
                tail = sum(comb(len(some), j) * 0.025**j * 0.975 ** (len(some) - j) for j in range(bad + 1))
                if bad >= len(some) * 0.025 or tail > 0.1 / (len(good) * 2):
                    break
                certified[lang, rule] = cut
    assert ("en", "symbols") in certified and ("en", "repeats") in certified and ("de", "symbols") not in certified
    want, by_base = set(), set()
    for i, f in found.items():
        if f[0] < 50 or 100 * f[4] > 50 * f[0]:
            continue
        by_base.add(i)
        if not any(100 * ratio[r](f)[0] > c * ratio[r](f)[1] for (lang, r), c in certified.items() if lang == strata[i]):
            want.add(i)
    assert {r["doc_id"] for r in kept} == want and len(want) < len(by_base) < len(docs)


def test_lines(outputs):
    before, after = outputs[0][1:3]
    want = brute_lines([(r["doc_id"], r["text"]) for r in before])
    texts = {i: text for (i, old), (text, gone) in want.items() if not gone or tokens(text)}
    assert {r["doc_id"]: r["text"] for r in after} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in after) and sum(len(t) for t in texts.values()) < sum(len(r["text"]) for r in before)


def test_near(outputs):
    before, after = outputs[0][2:4]
    component = brute_components({r["doc_id"]: shingles(r["text"], 5) for r in before})
    assert {r["doc_id"] for r in after} == {i for i, c in component.items() if i == c} and len(after) < len(before)


def test_mix(outputs):
    before, after = outputs[0][3:5]

    def leaf(r):
        return ("curated" if r["source"] == "src12" else "web", r["lang"] or "", r["source"])

    size, used = {}, {}
    for rows, sums in ((before, size), (after, used)):
        for r in rows:
            sums[leaf(r)] = sums.get(leaf(r), 0) + len(tokens(r["text"]))
    budget = {(): sum(size.values()) * 80 // 100}
    weights = [{"web": 3, "curated": 2}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {}]
    for depth in range(3):
        for parent in {x[:depth] for x in size}:
            names = {x[depth] for x in size if x[:depth] == parent}
            caps = [(n, weights[depth].get(n, 1), sum(v for x, v in size.items() if x[: depth + 1] == (*parent, n))) for n in names]
            budget |= {(*parent, n): b for n, b in fill(caps, budget[parent]).items()}
    longest = max(len(tokens(r["text"])) for r in before)
    assert all(budget[x] - longest < used.get(x, 0) <= budget[x] for x in size)
    assert {tuple(r) for r in after} < {tuple(r) for r in before}


def test_packed(outputs):
    rows, whole = outputs[0][4], outputs[1]
    pieces = outputs[0][5]
    ids = {r["doc_id"]: [*i, 1] for r, i in zip(rows, tokenizer(tokenizer_path())._encode([r["text"] for r in rows]), strict=True)}
    for got in (pieces, whole):
        at = {}
        for p in sorted(got, key=lambda p: (p["doc_id"], p["start"])):
            own = ids[p["doc_id"]]
            assert p["start"] == at.get(p["doc_id"], 0) and p["doc_tokens"] == len(own)
            assert p["ids_crc32"] == zlib.crc32(np.array(own[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            at[p["doc_id"]] = p["start"] + p["length"]
        assert at == {k: len(v) for k, v in ids.items()}
