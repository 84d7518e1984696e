import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import bpe, packing, token_files, tokens

ODD = [
    None, "", "  ", "<|endoftext|> hi", "x<|startoftext|><|endoftext|>Y", "\x1c a\x1db", "ΣΑΣ Σ'", "İstanbul ŉ ǅ ß ﬁ", "a b c\u0085d\xa0e", "e\u0301 é",
    "'S'LL I'll don'T x'ſ", "日本語 テキスト", "ab\u200bc\xadx", "²³¼ ⅷ Ⅷ", "a\x00b \x7f", "ªº µ", "ab" * 3000, "é" * 700, "the, (the) the. 123 4a5",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.vocabulary_path())


@pytest.fixture(scope="module")
def texts(spark, small):
    return [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]


@pytest.mark.parametrize("make", [tokens.encoder, bpe.bpe])
def test_ids_are_the_librarys(library, texts, make):
    every = ODD + texts
    for text, ids in zip(every, make(tokens.vocabulary_path()).encode(every), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("make", [tokens.encoder, bpe.bpe])
def test_every_code_point_alone_and_inside_words(library, make):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    plain = [c for c in points if ord(c) < 0x20000 or 0xE0000 <= ord(c) < 0xE0200 or ord(c) % 61 == 0]
    own = make(tokens.vocabulary_path())
    for frame in ("{}", "ab{}Cd {}"):
        texts = [frame.format(c, c) for c in plain]
        for at in range(0, len(texts), 4096):
            want = library.encode_batch(texts[at : at + 4096], add_special_tokens=False)
            got = own.encode(texts[at : at + 4096])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]
    whole = "a?" + "b ".join(points)
    assert np.frombuffer(own.encode([whole])[0], "<u4").tolist() == library.encode(whole, add_special_tokens=False).ids


def test_dictionaries_stay_bounded_and_right(library, texts):
    small = bpe.Bpe(tokens.vocabulary_path())
    small.chunks.most, small.pieces.most = 50, 20
    for text, ids in zip(texts[:20], small.encode(texts[:20]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(small.chunks) <= 50 and len(small.pieces) <= 20


def test_heap_and_scan_merge_alike():
    own, rng = bpe.bpe(tokens.vocabulary_path()), random.Random(4)
    for _ in range(200):
        word = "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))).encode()
        parts = [*(own.inner[b] for b in word[:-1]), own.last[word[-1]]]
        assert own._merged_long(parts) == own.merged(word)


def test_round_trip_rows(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)] + [(0, None, "x")], "doc_id long, text string, ids string")
    rows = bpe.round_trip(docs).collect()
    assert len(rows) == len(ODD) + 1
    for row in rows:
        ids = library.encode(ODD[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs)).collect()}
    assert decoded[18] == library.decode(library.encode(ODD[18], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.round_trip(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [4, 8, 11])
def test_codes_are_addressable(bits):
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 1 << rng.integers(1, 32), n).astype(np.uint32) for n in (0, 1, 7, 5000, 513)]
    file = token_files.TokenFile(token_files.dump([5, None, 7, 8, 9], arrays, bits))
    flat = np.concatenate(arrays)
    assert file.between(0, len(flat)).tolist() == flat.tolist() and len(file) == len(flat)
    for first, last in rng.integers(0, len(flat) + 1, (300, 2)).tolist():
        assert file.between(min(first, last), max(first, last)).tolist() == flat[min(first, last) : max(first, last)].tolist()
    for i in [0, 1, 7, 8, 511, 512, 1023, len(flat) - 1, *rng.integers(0, len(flat), 300).tolist()]:
        assert file[i] == flat[i]
    assert file.document(2).tolist() == arrays[2].tolist() and file.doc_ids.tolist() == [5, token_files.NO_ID, 7, 8, 9]
    with pytest.raises(IndexError):
        file[len(flat)]
    with pytest.raises(ValueError):
        token_files.TokenFile(token_files.dump([1], arrays[1:2], bits) + b"x")


def test_token_files_hold_every_document_in_order(spark, library, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "null id"), (10**6, None), (10**6 + 1, "")], "doc_id long, text string"))
    got = sorted(token_files.write_and_read(spark, docs.repartition(5)).collect(), key=lambda r: r["start"])
    want = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    start = 0
    for row, doc in zip(got, want, strict=True):
        ids = np.array([*library.encode(doc["text"] or "", add_special_tokens=False).ids, token_files.END_ID], "<u4")
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (doc["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.write_and_read(spark, docs.limit(0)).count() == 0


def test_a_hot_id_is_written_by_several_tasks(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "_ranges", lambda docs: 6)
    rows = [(7 if i % 2 else i, f"text number {i}") for i in range(400)] + [(None, "x")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("part", F.lit(0)).repartition(3)
    manifest = token_files.write(docs, token_files.new_path(spark, "tokens"))
    assert manifest.count() == 6
    got = sorted(token_files.read(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(len(got))]
    mark = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, token_files.END_ID], "<u4").tobytes())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == Counter((d, mark(t)) for d, t in rows)


def test_texts_are_cut_into_blocks_by_rows_and_size():
    texts = ["a" * 10, None, "", "b" * 5_000_000, "c" * 3_000_000, "d" * 2_000_000] + ["e"] * 1000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    blocks = list(tokens.cut(iter([batch.slice(1), batch])))
    assert [x for ids, _ in blocks for x in ids.to_pylist()] == [*range(1, len(texts)), *range(len(texts))]
    assert [t for _, part in blocks for t in part] == texts[1:] + texts
    assert all(len(part) <= tokens.BLOCK_ROWS and (len(part) == 1 or sum(len(t or "") for t in part) <= tokens.BLOCK_BYTES) for _, part in blocks)


def sized_blocks():
    """``tokens.blocks`` that fails at batches of over ``BLOCK_BYTES`` and a row; made here, so that it goes to workers as it is."""
    most = tokens.BLOCK_BYTES + 20_000

    def blocks(batches, path):
        for batch in batches:
            assert batch.column(1).nbytes <= most, batch.column(1).nbytes
            yield from tokens.blocks(iter([batch]), path)

    return blocks


def test_packing_gets_long_texts_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "blocks", sized_blocks())
    docs = spark.range(0, 800, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2500).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert packing.pack_documents(docs).agg(F.sum("length")).first()[0] == 800 * 2501
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == int(before.rstrip("b"))


def test_token_files_get_long_texts_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(token_files, "blocks", sized_blocks())
    docs = spark.range(0, 800, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2500).alias("text"))
    assert token_files.write(docs, token_files.new_path(spark, "tokens")).agg(F.sum("n_ids")).first()[0] == 800 * 2501


def test_ranges_hang_on_the_size_of_the_texts(spark, tmp_path, monkeypatch):
    texts = [(i, random.Random(i).randbytes(500).hex(), "en", "web", 1000) for i in range(480)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents")
    size = sum(f.stat().st_size for f in (tmp_path / "documents").glob("*.parquet"))
    monkeypatch.setattr(token_files, "RANGE_BYTES", -(-size // 12))
    manifest = token_files.write(spark.read.parquet(f"{tmp_path}/documents"), token_files.new_path(spark, "tokens"))
    assert [r["n_docs"] for r in manifest.orderBy("part").collect()] == pytest.approx([40] * 12, abs=20)


def brute_bins(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([10, 17, 30, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 10))]
        runs = packing.complete_bins(Counter(items), capacity)
        used = Counter()
        for run in runs:
            assert sum(s * n for s, n in run.items) <= capacity
            used.update({s: n * run.bins for s, n in run.items})
        assert used == Counter(items)
        assert sum(r.bins for r in runs) == brute_bins(items, capacity)


def test_packing_covers_every_id_once(spark, library, small):
    extra = spark.createDataFrame([(10**6, None), (10**6, None), (10**6 + 1, "word " * 5000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").union(extra)
    rows = packing.pack_documents(docs).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    total = sum(r["length"] for r in rows)
    assert len(sequences) == -(-total // packing.CAPACITY)
    for doc in docs.collect():
        ids = np.array([*library.encode(doc["text"] or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        at = 0
        for k, start, length, mark in sorted(set(pieces[doc["doc_id"]])):
            assert start == at == k * packing.CAPACITY and mark == zlib.crc32(ids[start : start + length].tobytes())
            assert length == packing.CAPACITY or start + length == len(ids)
            at += length
        assert at == len(ids)
    assert len(pieces[10**6]) == 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_sequences_hold_the_ids(spark, library):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "")], "doc_id long, text string")
    packed = packing.pack_documents(docs, capacity=6)
    found = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, packed).collect()}
    for r in packed.collect():
        ids = [*library.encode({1: "one two three", 2: "four", 3: ""}[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert found[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == ids[r["start"] : r["start"] + r["length"]]


def test_pack_keeps_clashing_columns_and_repeated_rows(spark):
    rows = [(7, 1, 5, "x", 9)] * 500 + [(9, 2, 5, "y", 9)] * 3 + [(3, 3, 5, "z", 9)] * 100
    parts = spark.createDataFrame(rows, "length long, doc_id long, rank int, _salt string, offset int")
    got = packing.pack(parts, 10)
    assert got.columns == ["length", "doc_id", "rank", "_salt", "sequence_id", "offset"]
    placed = defaultdict(list)
    for r in got.collect():
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        assert (r["rank"], r["_salt"]) == (5, {1: "x", 2: "y", 3: "z"}[r["doc_id"]])
    assert all(sorted(p)[0][0] == 0 and sum(x for _, x in p) <= 10 for p in placed.values())
    assert sum(map(len, placed.values())) == 603 and len(placed) == 503 == packing.gap(parts, 10)[0] == packing.gap(parts, 10)[1]


def test_an_unbounded_search_is_optimal_where_a_small_one_is_not():
    items = [6, 6, 6, 6, 5, 5, 5, 5, 4, 4, 4, 4, 3, 3, 3, 3, 2, 2, 2, 2]
    for capacity in (13, 16, 17, 19):
        runs = packing.complete_bins(Counter(items[:14]), capacity, None, None)
        assert sum(r.bins for r in runs) == brute_bins(items[:14], capacity)


def test_fillings_of_least_waste_are_looked_at_first():
    sizes = list(range(400, 1101))
    found = packing._fillings(948, sizes, dict.fromkeys(sizes, 1), 500, 64)
    assert len(found) == 64 and {sum(s * n for s, n in f) for f in found} == {948}
    assert packing._fillings(10, [3, 4], {3: 2, 4: 1}, 10, 64) == [((4, 1), (3, 2))]
    assert packing._fillings(2, [], {}, 5, 64) == [()]
    assert packing.BUDGET == 20_000
