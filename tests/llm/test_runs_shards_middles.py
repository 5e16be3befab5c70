"""Periodic runs, balanced shards and fill-in-the-middle texts against plain rules."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from circuitscope.llm import bpe, fim, periodic, sharding
from circuitscope.llm.queries import QUERIES
from circuitscope.llm.words import find_words, hash_words, slices

ODD = [None, "", " \t\n", "é", "漢字 かな 😀 x", "a < b <P > <S", "has <P> in it", "x<", "<S", "P>", "the <M>", "word " * 9, "a b " * 40 + "c", "tail a a a a a a"]


def odd_documents(spark, texts=ODD):
    """Ids with a null and a repeated row, and columns whose names the operators use."""
    rows = [(k if k else None, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in (
        "n", "form", "output", "runs", "n_words", "size", "tokens", "shard", "slot", "cell", "unit", "g1", "group", "__text")})


# --- runs

def plain_runs(words):
    """Every run by its definition, period by period; a stretch belongs to its smallest period."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_text(rng, n):
    words = []
    while len(words) < n:
        if rng.random() < 0.5:
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
            words += (unit * 12)[:rng.randint(1, len(unit) * 11)]
        else:
            words += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 10))]
    return words[:n]


def test_overlap():
    assert periodic.least_overlap() == 5 and periodic.least_overlap(12, 4) == 9 and periodic.least_overlap(4, 4) == 3
    for words, exponent in ((6, 4), (12, 4), (13, 5), (1, 4), (40, 7)):
        assert periodic.least_overlap(words, exponent) == min(max(words, exponent * q) - q for q in range(1, 100))


@pytest.mark.parametrize("size, group", [(1 << 18, 1 << 17), (64, 1 << 17), (1 << 18, 10)])
def test_runs_by_definition(monkeypatch, size, group):
    monkeypatch.setattr(periodic, "GROUP_WORDS", group)
    rng = random.Random(size + group)
    texts = [" ".join(periodic_text(rng, rng.randint(0, 90))) for _ in range(300)] + [" ".join("a" * 700), None, "", " ".join("ab" * 300 + "c" + "ab" * 300)]
    runs = 0
    for first, part in slices(pa.array(texts), size=size):
        words = find_words(part)
        begin, end, period = periodic.text_runs(part, words)
        at = np.cumsum(words.counts) - words.counts
        got = defaultdict(list)
        for b, e, q in zip(begin.tolist(), end.tolist(), period.tolist()):
            t = int(words.text[b])
            got[t].append((b - int(at[t]), e - b, q))
        for t in range(len(part)):
            want = plain_runs((texts[first + t] or "").split())
            assert got[t] == want
            runs += len(want)
    assert runs > 300


def test_mask_keeps_every_word_of_a_run():
    rng = random.Random(4)
    texts = [" ".join(periodic_text(rng, 60)) for _ in range(100)] + [" ".join(str(k) for k in range(100))]
    (_, part), = slices(pa.array(texts))
    words = find_words(part)
    inside = periodic.survivors(words, hash_words(part, words), 5)
    at = np.cumsum(words.counts) - words.counts
    for t, text in enumerate(texts):
        for s, length, _ in plain_runs(text.split()):
            assert inside[at[t] + s:at[t] + s + length].all()
    assert not inside[at[100]:].any()


def test_words_told_apart_by_bytes_when_hashes_meet(monkeypatch):
    monkeypatch.setattr(periodic, "hash_words", lambda texts, words: np.full(len(words.starts), 7, "u8"))
    (_, part), = slices(pa.array(["a b c d e f g h", "a a a a a a"]))
    assert [x.tolist() for x in periodic.text_runs(part, find_words(part))] == [[8], [14], [1]]


def plain_row(doc_id, text):
    """The contract of the query, row by row."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
            sha(plain_collapsed(words, runs)))


def test_query_of_runs_by_definition(spark, tmp_path):
    rng = random.Random(8)
    texts = [t for t in ODD] + [" ".join(periodic_text(rng, rng.randint(0, 200))) for _ in range(150)] + ["\x0b".join("xy" * 50), "ü ß " * 30]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in QUERIES["op11_runs"](spark, str(tmp_path)).collect())
    assert got == [plain_row(k, t) for k, t in enumerate(texts)]


def test_runs_of_odd_rows_long_texts_and_empty_tables(spark):
    found = periodic.find_runs(odd_documents(spark))
    rows = found.collect()
    assert len(rows) == len(ODD) + 1 and sum(r.doc_id is None for r in rows) == 1
    by_id = {r.doc_id: r for r in rows}
    assert by_id[11].runs[0].asDict() == {"start": 0, "length": 9, "period": 1} and by_id[11].collapsed == "word"
    assert by_id[12].collapsed == "a b c" and by_id[13].collapsed == "tail a"
    assert by_id[None].runs == [] and by_id[1].collapsed == ""
    long = " ".join([str(k) for k in range(50_000)] + ["x y z"] * 30_000)
    r = periodic.find_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(50_000, 90_000, 3)] and r.collapsed.endswith("49999 x y z")
    assert periodic.find_runs(odd_documents(spark).limit(0)).count() == 0
    assert periodic.with_planted_runs(odd_documents(spark)).count() == len(ODD) + 1


# --- shards

def plain_place(vectors, shards):
    total = [sum(v[d] for v in vectors) or 1 for d in range(3)]
    room = [[1.0] * 3 for _ in range(shards)]
    out = []
    for v in vectors:
        part = [v[d] / total[d] * shards for d in range(3)]
        scores = [sum(a * b for a, b in zip(r, part)) for r in room]
        k = max(range(shards), key=lambda s: (round(scores[s], 12), -s))
        room[k] = [a - b for a, b in zip(room[k], part)]
        out.append(k)
    return out


def test_place_by_plain_rule():
    rng = random.Random(3)
    for _ in range(20):
        vectors = sorted(([rng.randint(1, 1000), rng.randint(1, 300), rng.randint(1, 5)] for _ in range(rng.randint(1, 200))), reverse=True)
        assert sharding.place(np.array(vectors, "f8"), 16).tolist() == plain_place(vectors, 16)
    assert sharding.place(np.zeros((0, 3)), 16).tolist() == []


def corpus(spark, n=6000):
    """A text that a third of all rows hold, one that a twentieth hold, groups of up to 40, long and short texts."""
    rng = random.Random(2)
    word = lambda: rng.choice(("alpha", "beta", "gamma", "Straße", "漢字")) + str(rng.randint(0, 999))
    text = lambda n: " ".join(word() for _ in range(n))
    hot, warm = text(30), text(60)
    texts = [hot] * (n // 3) + [warm] * (n // 20)
    while len(texts) < n:
        texts += [text(int(2 ** rng.uniform(0, 9)))] * (rng.randint(2, 40) if rng.random() < 0.02 else 1)
    texts = texts[:n - 3] + [None, "", None]
    rng.shuffle(texts)
    return spark.createDataFrame([(10 * k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5, "doc_id"), texts, hot


def test_shards_are_near_equal_whole_and_gapless(spark):
    docs, texts, hot = corpus(spark)
    rows = sharding.assign(docs).collect()
    assert sorted(r.doc_id for r in rows) == [10 * k for k in range(len(texts))]
    slots, groups = defaultdict(list), defaultdict(set)
    sums = np.zeros((16, 3))
    for r in rows:
        text = texts[r.doc_id // 10] or ""
        assert (r["size"], r.text_crc32) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        slots[r.shard].append(r.slot)
        groups[text].add(r.shard)
        sums[r.shard] += (r["size"], r.tokens, 1)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 16
    total = sums.sum(0)
    held = defaultdict(lambda: np.zeros(3))
    for r in rows:
        held[texts[r.doc_id // 10] or ""] += (r["size"], r.tokens, 1)
    cut = {t for t, s in groups.items() if len(s) > 1}
    assert hot in cut and all((held[t] / total).max() * 16 > 0.5 for t in cut), "only a group beyond half a share is cut"
    share = sums / sums.mean(0)
    assert np.abs(share[:, 0] - 1).max() < 0.02 and np.abs(share - 1).max() < 0.05, share
    assert [tuple(r) for r in sharding.totals(sharding.assign(docs.repartition(3))).orderBy("shard").collect()] == [
        tuple(r) for r in sharding.totals(spark.createDataFrame(rows)).orderBy("shard").collect()], "partitioning doesn't matter"


def test_tokens_are_the_vocabularys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    rows = {r.doc_id: r.tokens for r in sharding.assign(odd_documents(spark)).collect()}
    assert rows == {k if k else None: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in enumerate(ODD)}


def test_shards_of_odd_rows_and_empty_tables(spark):
    rows = sharding.assign(odd_documents(spark), shards=3).collect()
    assert len(rows) == len(ODD) + 1 and {r.shard for r in rows} <= {0, 1, 2}
    for k in range(3):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.assign(odd_documents(spark).limit(0)).count() == 0
    same = spark.createDataFrame([(7, "one text")] * 200, "doc_id long, text string")
    assert sorted(r.slot for r in sharding.assign(same, shards=4).where("shard = 0").collect()) == list(range(sharding.assign(same, shards=4).where("shard = 0").count()))


# --- middles

def plain_middle(doc_id, text):
    """The contract of the query, row by row."""
    text = text or ""
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", text, None, None
    if h[3] % 100 < 20:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", a, b - a
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", a, b - a


def test_rank_and_select_by_counting():
    rng = random.Random(5)
    for size in (0, 1, 7, 63, 64, 65, 511, 512, 513, 5000):
        text = "".join(rng.choice("aé漢😀") for _ in range(size))
        data = np.frombuffer(text.encode(), "u1")
        bounds = fim.Boundaries(data)
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
        assert bounds.rank(np.array(at)).tolist() == list(range(size + 1))
        assert bounds.select(np.arange(size)).tolist() == at[:-1]


@pytest.mark.parametrize("size", [1 << 18, 40])
def test_middles_by_definition(spark, monkeypatch, size):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice("ab é漢😀<>PSM") for _ in range(rng.randint(0, 300))) for _ in range(400)] + ["漢 x" * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(fim, "slices", lambda column: slices(column, size=size))
    rows = fim.transform(docs).withColumn("back", fim.restore()).collect()
    forms = set()
    for r in rows:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_middle(r.doc_id, texts[r.doc_id])
        assert r.back == (texts[r.doc_id] or "")
        forms.add(r.form)
    assert forms == {"plain", "spm", "psm"} and len(rows) == len(texts)


def test_query_of_middles(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in QUERIES["op13_fim"](spark, str(tmp_path)).collect():
        n, form, output, prefix, middle = plain_middle(r.doc_id, ODD[r.doc_id])
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, sha(output), sha(ODD[r.doc_id] or ""))


def test_middles_of_odd_rows_and_empty_tables(spark):
    rows = fim.transform(odd_documents(spark)).withColumn("back", fim.restore()).collect()
    assert sorted((r.back for r in rows)) == sorted((t or "") for t in [*ODD, ODD[3]])
    assert [r for r in rows if r.doc_id == 3][0] == [r for r in rows if r.doc_id == 3][1]
    assert fim.transform(odd_documents(spark).limit(0)).count() == 0
    with pytest.raises(ValueError):
        fim.Sentinels("<P>", "<S>", "<P>")
    with pytest.raises(ValueError):
        fim.Sentinels("aba", "<S>", "<M>")
