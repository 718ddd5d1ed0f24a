"""Near-duplicates, components and decontamination against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, simhash
from tracewright.llm.components import components


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 200 + i) for i in range(50)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + links[:10]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == roots_of({n for link in real for n in link}, real)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def fingerprint(text, width):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two\x0bTHREE", "É é x y z", "a b c d " * 40, "w " * 70_000, "x y z"])
def test_fingerprints_follow_the_definition(text):
    assert simhash.fingerprint(text, 4) == fingerprint(text, 4)


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [8192, 5])
def test_links_join_all_within_the_radius(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    found = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(6):
            found.add(base)
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                base ^= 1 << bit
    centre = rng.getrandbits(64)  # a dense group
    found |= {centre ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(16)}
    fps = sorted(found | {0, 1, (1 << 64) - 1})
    links = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(as_long(f),) for f in fps], "__fp long")).collect()]
    values = np.array(fps, np.uint64)
    near = [(as_long(fps[i]), as_long(fps[j])) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4)]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in links)
    assert roots_of(map(as_long, fps), links) == roots_of(map(as_long, fps), near)


DOCS = "doc_id long, text string, fingerprint string, component_id int, __fp string, n int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, "x", 2) for i, t in rows], DOCS)


def test_groups_and_what_stays(spark):
    long = " ".join(f"word{i % 97}x{i % 13}" for i in range(3000))
    rows = [(5, long), (3, long + " end"), (9, "short text"), (9, "short text"), (10, None), (11, ""), (12, " \n"), (None, long), (20, "other words here now and then")]
    docs = docs_of(spark, rows)
    found = simhash.groups(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in found) == sorted(
        [("5", 3), ("3", 3), ("None", 3), ("9", 9), ("9", 9), ("10", 10), ("11", 10), ("12", 10), ("20", 20)]
    )
    assert {r.fingerprint for r in found if r.doc_id == 10} == {"0" * 16}
    kept = simhash.distinct(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 10, 20]
    alone = simhash.distinct(docs_of(spark, [(None, "a b c d e"), (None, "a b c d e"), (None, "quite another text"), (1, "third one")]))
    assert sorted(r.text for r in alone.collect()) == ["a b c d e", "quite another text", "third one"]
    # one id on the smallest texts of two groups: both groups keep a row
    twice = [(1, "a b c d e f g"), (1, "quite another text of some words"), (2, "a b c d e f g"), (3, "quite another text of some words"), (4, "third")]
    kept = simhash.distinct(docs_of(spark, twice + twice[:2]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c d e f g"), (1, "quite another text of some words"), (4, "third")]
    assert simhash.groups(docs.limit(0)).collect() == [] and simhash.distinct(docs.limit(0)).collect() == []


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def similar(docs, items):
    found = {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        width = min(5, len(words))
        bag = Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))
        for doc, body in docs:
            own = words_of(body)
            grams = [tuple(own[i : i + width]) for i in range(len(own) - width + 1)]
            for start in range(len(grams)):
                window = Counter(grams[start : start + bag.total()])
                shared = sum(min(n, window[g]) for g, n in bag.items())
                value = shared / (window.total() + bag.total() - shared)
                if value >= 0.8:
                    found[doc, item] = max(found.get((doc, item), 0), round(value, 9))
    return found


def test_decontamination_finds_all_similar_windows(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("ar", "el", "in", "os")]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(text(rng.choice([30, 45, 60])))) for i in range(8)]
    items += [(20, "Three short words"), (21, None), (22, " .,; "), (23, "echo " * 30), (24, items[0][1]), (25, "Ünïcode wörds ßtay höre always")]
    docs = []
    for i in range(60):
        own = text(rng.randrange(0, 80))
        leak = rng.choice(items)[1] or ""
        part = leak.split()
        if i % 3 == 0 and len(part) > 40:
            part[rng.choice([0, -1])] = "changed"
        if i % 7 == 0:
            part = part[: int(len(part) * 0.9)]
        if i % 5 == 0:
            part = [w.upper() + "," for w in part]
        docs.append((i, " ".join(own[:20] + (part if i % 4 else []) + own[20:])))
    docs += [(100, None), (101, ""), (102, items[1][1]), (103, "echo " * 500), (None, items[2][1]), (102, items[1][1]), (104, "three SHORT words")]
    frame, bench = docs_of(spark, docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.matches(frame, bench).collect()}
    want = similar(docs, items)
    assert got == want and len(want) > 40
    clean = decontaminate.clean(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in docs if not any(d == i for d, _ in want))
    assert decontaminate.matches(frame.limit(0), bench).collect() == [] and decontaminate.matches(frame, bench.limit(0)).collect() == []
    assert decontaminate.clean(frame, bench.limit(0)).count() == len(docs)


def test_shuffled_joins_give_the_same_as_broadcasts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plain = sorted(map(tuple, decontaminate.matches(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MOST_SHARED", -1)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == plain


def test_every_fingerprint_within_the_radius_shares_a_block():
    rng = random.Random(1)
    for _ in range(2000):
        flips = rng.sample(range(64), decontaminate.RADIUS)
        size = 64 // decontaminate.BLOCKS
        assert min(sum(f // size == b for f in flips) for b in range(decontaminate.BLOCKS)) <= decontaminate.FLIPS


def test_native_fingerprint_is_the_majority_of_bits(spark):
    rng = random.Random(2)
    bags = [[rng.getrandbits(64) for _ in range(n)] for n in (1, 2, 3, 8, 41)]
    frame = spark.createDataFrame([(i, [as_long(x) for x in b]) for i, b in enumerate(bags)], "i int, grams array<long>")
    got = {r.i: r.fp & (1 << 64) - 1 for r in decontaminate.fingerprinted(frame).select("i", F.col("fp")).collect()}
    assert got == {i: sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in b) > len(b)) for i, b in enumerate(bags)}


def test_one_word_changed_in_the_middle_of_a_passage_is_found(spark):
    rng = random.Random(5)
    passages = [[f"w{rng.randrange(10**6)}" for _ in range(49)] for _ in range(400)]
    items = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join([*p[:24], "changed", *p[25:]])) for i, p in enumerate(passages)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(i, i) for i in range(400)}
