"""Token ids: the word table, blocks on disk, packing into sequences."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from circuitscope.llm import bpe, packing, pfor
from circuitscope.llm.queries import QUERIES
from circuitscope.llm.words import slices

TEXTS = ["Hello, World! don't", None, "", " \t", "naïve Straße ÀÉ. ñandú", "a\x0bb a,\x0b.", "x y z 漢字 かな 12 345", "<|endoftext|>mid<|startoftext|> <|end",
         "ΑΣ é é İ", "word " * 5000, "z" * 3000, "Hello, World! don't", "é̀ ́start !!??"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def documents(spark):
    return spark.createDataFrame([(len(TEXTS) - k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("words", F.lit("x"))


def test_cached_encoder_is_the_library(library):
    encoder = bpe.CachedEncoder(bpe.vocabulary_path())
    want = [ids_of(library, t) for t in TEXTS]
    for size in (1, 100, 1 << 20, 1 << 20):
        got = []
        for _, texts in slices(pa.array(TEXTS), size=size):
            ids, counts = encoder.encode(texts)
            got += [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == want
        encoder.known.clear()


def test_word_table_encodes_and_decodes(spark, library):
    want = {len(TEXTS) - k: ids_of(library, t) for k, t in enumerate(TEXTS)}
    got = {r.doc_id: r for r in bpe.encode_decode(documents(spark)).collect()}
    assert {i: r.ids for i, r in got.items()} == want
    assert all(r.decoded == library.decode(want[i], skip_special_tokens=False) and r.n_tokens == len(want[i]) for i, r in got.items())
    digests = {r.doc_id: r for r in bpe.encode_decode(documents(spark), digests_only=True).collect()}
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, want[i])).encode()).hexdigest() for i, r in digests.items())
    assert all(r.decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest() for i, r in digests.items())
    assert bpe.encode_decode(documents(spark).limit(0)).count() == 0


def test_blocks_of_any_size_agree(spark):
    docs = spark.createDataFrame([(k, f"same words here {k % 3}") for k in range(50)], "doc_id long, text string")
    assert len({(r.doc_id % 3, r.ids_sha256) for r in bpe.encode_decode(docs, digests_only=True, block_bytes=10).collect()}) == 3


def test_decode_joins_pieces(spark, library):
    rows = [(k, ids_of(library, t)) for k, t in enumerate(TEXTS)] + [(99, None), (98, [10**6])]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>")).collect()}
    assert all(got[k] == library.decode(ids, skip_special_tokens=False) for k, ids in rows[:-2]) and got[99] == got[98] == ""


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 49408, 2**32])
def test_packed_blocks_round_trip(n, high):
    rng = np.random.default_rng([n, high % 1000])
    ids = rng.integers(0, high, n, dtype="u8").astype("u4")
    if n > 50:
        ids[rng.integers(0, n, n // 50)] = rng.integers(0, 2**32, n // 50, dtype="u8").astype("u4")
    data, starts = pfor.pack(ids)
    assert data == b"".join(pfor.pack_block(ids[k:k + pfor.BLOCK_IDS]) for k in range(0, n, pfor.BLOCK_IDS))
    assert (pfor.unpack(data, starts) == ids).all()
    assert (pfor.unpack(data, starts, n // 3, n // 2) == ids[n // 3:n // 3 + n // 2]).all()


def test_outliers_are_exceptions_not_width():
    ids = np.arange(1024, dtype="u4") % 16
    ids[5] = 2**31
    assert len(pfor.pack_block(ids)) < 600


def test_file_of_tokens(spark, library, tmp_path):
    out = str(tmp_path / "tokens")
    docs = documents(spark).union(spark.createDataFrame([(100 + k, f"more text {k}") for k in range(300)], "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("words", F.lit("x")))
    pfor.write_tokens(docs, out, segment_ids=500)
    segments = spark.read.parquet(out)
    got = {r.doc_id: r for r in pfor.read_tokens(segments).collect()}
    start = 0
    for doc_id, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        ids = [*ids_of(library, text), 1]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids, r.ids_crc32) == (start, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert segments.count() > 3
    assert pfor.tokenize_and_read_back(docs.limit(0)).count() == 0


def test_packing_places_every_token(spark):
    rng = np.random.default_rng(9)
    lengths = [int(x) for x in rng.integers(1, 3000, 400)] + [8192, 8193, 40_000, 512, 1]
    rows = [(k, n) for k, n in enumerate(lengths)] + [(None, 77), (7, 0), (8, None), (9, -3)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("group", F.lit(1)).withColumn("n", F.lit("x"))
    got = packing.pack(items).toPandas()
    for k, n in [*enumerate(lengths), (None, 77)]:
        own = got[got.doc_id.isna() if k is None else got.doc_id == k].sort_values("piece")
        assert own.piece_tokens.sum() == n and (own.piece_start == own.piece * 8192).all()
    for _, b in got.groupby("bin"):
        b = b.sort_values("bin_offset")
        assert (b.bin_offset == b.piece_tokens.cumsum() - b.piece_tokens).all()  # no gap, no overlap
        used = b.piece_tokens.sum()
        assert b.capacity.nunique() == 1 and b.capacity.iloc[0] == min(c for c in packing.CAPACITIES if c >= used)
    bins = got.groupby("bin").capacity.first()
    assert got.piece_tokens.sum() / bins.sum() > 0.97
    assert packing.pack(items.limit(0)).count() == 0


def test_best_fit_prefers_least_room_and_cheap_bins():
    bins, offsets, sizes = packing.best_fit(np.array([6, 5, 4, 3, 2]), (4, 10), cost=lambda c: c)
    assert sizes.sum() == 20 and len(sizes) == 2
    _, _, sizes = packing.best_fit(np.array([3]), (4, 100))
    assert sizes.tolist() == [4]
    _, _, sizes = packing.best_fit(np.array([50, 2, 1]), (4, 64, 128), cost=lambda c: c * c)
    assert sizes.tolist() == [64]


def test_packing_counts_the_library_tokens(spark, library, tmp_path):
    docs = documents(spark)
    want = {len(TEXTS) - k: len(ids_of(library, t)) + 1 for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in pfor.token_counts(docs).collect()} == want
    assert pfor.token_counts(docs.limit(0)).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for packed in (QUERIES["op5_packing"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("piece_tokens").alias("n")).collect()} == want


def test_words_that_a_hash_may_confuse(spark, monkeypatch):
    from circuitscope.llm import bpe
    from circuitscope.llm.words import slices

    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    texts = [f"one {a} two {b} one", f"{b} {a}", None]
    (_, part), = slices(pa.array(texts))
    want = [i for t in texts for i in bpe.load(bpe.vocabulary_path()).encode(t or "", add_special_tokens=False).ids]
    assert bpe.CachedEncoder(bpe.vocabulary_path()).encode(part)[0].tolist() == want
    monkeypatch.setattr(bpe, "hash_words", lambda texts, words: words.ends.astype("u8") % np.uint64(2))  # all but two words collide
    assert bpe.CachedEncoder(bpe.vocabulary_path()).encode(part)[0].tolist() == want


def plain_best_fit(lengths, capacities, cost):
    """The same rules, bin by bin and item by item."""
    bins, placed = [], []
    for i, length in enumerate(lengths):
        open_ = [b for b in bins if b["room"] >= length]
        if open_:
            b = min(open_, key=lambda b: b["room"])
            same = [x for x in bins if x["room"] == b["room"]]
            b = max(same, key=lambda x: x["at"])  # of equal room the one that came to it last
        else:
            def rate(c):
                return cost(c) / min(c, length + sum(n for n in lengths[i + 1:] if n <= c - length))
            c = min((c for c in sorted(capacities) if c >= length), key=rate)
            b = {"number": len(bins), "room": c, "used": 0}
            bins.append(b)
        placed.append((b["number"], b["used"]))
        b["used"] += length
        b["room"] -= length
        b["at"] = i
    return placed, [min(c for c in capacities if c >= b["used"]) for b in bins]


def test_packing_against_plain_rules():
    rng = np.random.default_rng(9)
    for _ in range(120):
        capacities = tuple(sorted(rng.choice(np.arange(8, 70), 3, replace=False).tolist()))
        lengths = np.sort(rng.integers(1, max(capacities) + 1, rng.integers(1, 60)))[::-1]
        bins, offsets, fitted = packing.best_fit(lengths, capacities)
        want, sizes = plain_best_fit(lengths.tolist(), capacities, packing.sequence_cost)
        assert list(zip(bins.tolist(), offsets.tolist())) == want and fitted.tolist() == sizes


def test_packing_is_the_same_for_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 40)
    monkeypatch.setattr(packing, "RUN", 8)
    rng = np.random.default_rng(10)
    rows = [(int(k), int(n)) for k, n in enumerate(rng.integers(1, 5000, 200))] + [(7, 300)] * 100 + [(None, 20)] * 30 + [(3, 0), (4, None)]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    key = lambda t: [(x is None, x) for x in t]
    results = [sorted((tuple(r) for r in packing.pack(items.repartition(n), capacities=(256, 1024)).collect()), key=key) for n in (1, 2, 7)]
    assert results[0] == results[1] == results[2]
    assert sum(r[3] for r in results[0]) == sum(n for _, n in rows if n) and len({r[4] >> 24 for r in results[0] if r[0] == 7}) > 3


def test_vocabularies_of_another_kind_are_refused(spark):
    with pytest.raises(ValueError, match="word by word"):
        bpe.load(bpe.vocabulary_path("byte_bpe_50k.json"))
    with pytest.raises(Exception, match="word by word"):
        pfor.token_counts(documents(spark), bpe.vocabulary_path("byte_bpe_50k.json")).collect()


def test_groups_of_hashes_and_bytes_of_words():
    from circuitscope.llm import words as W

    texts = ["a bb ccccccccc a", "", "ccccccccd ccccccccc " + "x" * 40 + " " + "x" * 40, "bb é " + "y" * 17]
    _, slice_ = next(W.slices(pa.array(texts)))
    found = W.find_words(slice_)
    first, group = W.group_hashes(W.hash_words(slice_, found))
    plain = [w for t in texts for w in t.split()]
    order = list(dict.fromkeys(plain))
    assert [plain[i] for i in first] == order and [order[g] for g in group] == plain and [plain.index(w) for w in order] == first.tolist()
    assert W.same_bytes(slice_, found, first[group])
    for i, a in enumerate(plain):  # every pair of words, one at a time
        for j, b in enumerate(plain):
            other = np.arange(len(plain))
            other[i] = j
            assert W.same_bytes(slice_, found, other) == (a == b)
    none = W.find_words(W.Texts(np.zeros(0, "u1"), np.zeros(1, "i8")))
    assert W.same_bytes(W.Texts(np.zeros(0, "u1"), np.zeros(1, "i8")), none, np.zeros(0, "i8"))


def test_full_blocks_of_every_width():
    rng = np.random.default_rng(5)
    for width in range(33):
        ids = rng.integers(0, 1 << width, 3 * pfor.BLOCK_IDS + 7, dtype="u8").astype("u4")
        ids[::50] = rng.integers(0, 1 << 32, len(ids[::50]), dtype="u8").astype("u4")
        data, starts = pfor.pack(ids)
        assert (pfor.unpack(data, starts) == ids).all() and (pfor.unpack(data, starts, 1030, 900) == ids[1030:1930]).all()


def test_plain_words_are_told_by_their_bytes():
    from circuitscope.llm import words as W

    plain = {"abc": 3, "Abc,": 3, "x.;:!?": 1, "...": 0, "a1": -1, "1": -1, "a.b": -1, ".a": -1, "é": -1, "aé": -1, "a's": -1, "a-": -1}
    _, texts = next(W.slices(pa.array([" ".join(plain)])))
    found = W.find_words(texts)
    assert bpe._letters_in_front(texts, found.starts, found.ends).tolist() == list(plain.values())
    encoder = bpe.CachedEncoder(bpe.vocabulary_path())
    ids, counts = encoder.encode(texts)
    assert ids.tolist() == encoder.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids and counts.tolist() == [len(ids)]
