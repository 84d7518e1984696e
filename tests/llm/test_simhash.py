import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import simhash
from siftwell.llm.components import components


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(rows):
    ids, marks = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    return sorted((ids[i], marks[i], min(groups[find(i)])) for i in range(len(rows)))


def test_fingerprint_against_plain_loops():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "ONE two", "a b c", "É é İ a\xa0b c", "x " * 5000]
    texts += [" ".join(rng.choice(["The", "cat", "sat", "ön", "mat,"]) for _ in range(rng.randrange(60))) for _ in range(50)]
    for text in texts:
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


def test_components_against_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(150)) for _ in range(25)]
    rows = []
    for i, text in enumerate(base):
        words = text.split()
        for k in range(4):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "zz"
            rows.append((100 * i + k, " ".join(copy)))
    rows += [(9000, None), (9001, ""), (9001, ""), (9002, "w"), (9003, "W"), (9004, "a " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == brute_components(rows)


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(2)
    marks = {rng.getrandbits(64) for _ in range(30)}
    for m in list(marks):
        for flips in (1, 2, 3, 3, 4):
            x = m
            for b in rng.sample(range(64), flips):
                x ^= 1 << b
            marks.add(x)
    signed = np.array(sorted(marks), np.uint64).view(np.int64).tolist()
    want = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    assert len(got) == len(want) and {(r["u"], r["v"]) for r in got} == want


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = [(3, "same text here", "en"), (1, "same text here", "en"), (1, "same text here", "en"), (None, "same text here", "de"), (5, "an entirely different text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 1, 5]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_loses_no_text_of_its_own(spark):
    rows = [(3, "some text of the first kind", {"k": 1}, 1), (5, "some text of the first kind", {"k": 1}, 1), (5, "quite another text that is its own", {"k": 2}, 1), (5, "quite another text that is its own", {"k": 2}, 1), (None, "some text of the first kind", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark map<string,int>, fp int")
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, rows[4][1]), (3, rows[0][1]), (5, rows[2][1])]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r)) for r in simhash.keep_one(docs.repartition(3)).collect())
