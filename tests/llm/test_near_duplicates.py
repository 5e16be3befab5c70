"""SimHash and embedding near-duplicates against brute force."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from circuitscope.llm import embeddings, near_copies, simhash
from circuitscope.llm.components import connected_components


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text, size=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_defined_one(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "One", "A b C d", "a b c d e f a b c d", "É x y z w q", "w " * 3000, "x" * 200_000]
    for t in texts:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    for s in ("a b c d", "É x"):  # Spark's own hash is the same one
        row = spark.range(1).select(F.xxhash64(F.lit(s)).alias("h")).first()
        assert row.h % 2**64 == xxhash.xxh64_intdigest(s.encode(), 42)


def near(base, rng, n):
    for b in rng.sample(range(64), n):
        base ^= 1 << b
    return base


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps |= {base, *(near(base, rng, rng.randint(1, 7)) for _ in range(4))}
    centre = rng.getrandbits(64)
    fps |= {near(centre, rng, rng.randint(0, 3)) for _ in range(250)}  # values shared by more than the crowd
    fps |= {0, 1 << 63, (1 << 64) - 1}
    want = groups(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    rows = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for crowd in (4, 64):
        links = [(r.src % 2**64, r.dst % 2**64) for r in simhash.hamming_links(rows, crowd).collect()]
        assert all(0 < (a ^ b).bit_count() <= 4 for a, b in links)
        assert groups(fps, links) == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(220)] + [(7, 7), (500, 600), (600, 500)] + [(700, 701 + k) for k in range(80)]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    rows = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(rows).collect()}
    assert got == groups(nodes, [e for e in edges if e[0] != e[1]])
    assert connected_components(rows.limit(0)).count() == 0


def test_near_duplicates_of_documents(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(3, text), (1, text.upper()), (2, text + " tail"), (9, None), (8, ""), (8, ""), (None, text), (5, "something else entirely here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(0)).withColumn("key", F.lit(1))
    got = sorted([tuple(r) for r in simhash.near_duplicates(docs).collect()], key=str)
    by_id = {r[0]: r[2] for r in got}
    assert len(got) == 8 and by_id[3] == by_id[1] == by_id[None] == 1 and by_id[9] == by_id[8] == 8 and by_id[5] == 5
    assert dict((r[0], r[1]) for r in got)[8] == "0" * 16
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def edited(rng, source, n):
    out = list(source)
    for k in rng.sample(range(len(out)), n):
        out[k] = "".join(rng.choices("klmnop", k=6))
    return out


def test_deduplicate_keeps_one_of_each_group(spark):
    rng = random.Random(11)
    bases = [words(rng, 300) for _ in range(12)]
    rows, gone, kept = [], set(), set()
    for k, base in enumerate(bases):
        rows.append((10 * k, " ".join(base)))
        rows.append((10 * k + 1, " ".join(base).upper()))
        rows.append((10 * k + 2, " ".join(edited(rng, base, 2))))  # similarity about 0.93
        kept.add(10 * k)
        gone |= {10 * k + 1, 10 * k + 2}
        rows.append((10 * k + 3, " ".join(edited(rng, base, 60))))  # similarity about 0.2
        kept.add(10 * k + 3)
    hot = words(rng, 300)
    rows += [(1000 + k, " ".join(edited(rng, hot, 1))) for k in range(120)]  # more than the crowd
    kept.add(1000)
    rows += [(None, "no id"), (5000, "short one"), (5001, "short one"), (5002, None), (5003, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("key", F.lit("k"))
    left = near_copies.deduplicate(docs)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns
    assert set(ids) == kept | {None, 5000, 5002} and len(ids) == len(set(ids))
    assert near_copies.deduplicate(docs.limit(0)).count() == 0


def test_near_copies_have_the_exact_similarity(spark):
    rng = random.Random(21)
    rows, linked, apart = [], [], []
    for k in range(300):
        base = words(rng, 300)
        other = base[:]
        for at in range(rng.randint(3, 9)):  # so many replaced runs, far apart
            other[20 + 30 * at:22 + 30 * at] = words(rng, 2)
        a, b = ({tuple(x[i:i + 5]) for i in range(296)} for x in (base, other))
        j = len(a & b) / len(a | b)
        if 0.68 <= j <= 0.92:
            (linked if j >= 0.8 else apart).append(k)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id for r in near_copies.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(linked) > 80 and len(apart) > 50
    assert not [k for k in apart if 2 * k in got or 2 * k + 1 in got]
    assert sum(2 * k in got and 2 * k + 1 in got for k in linked) >= 0.96 * len(linked)


def similar(texts):
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    return [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def test_a_large_group_of_near_copies_loses_no_link(spark):
    rng = random.Random(31)
    base = words(rng, 120)
    texts = [base]
    for _ in range(500):  # from nearly equal to far apart; some differ from the base in one way together
        other = edited(rng, base, rng.randint(1, 16))
        texts.append(edited(rng, rng.choice(texts), rng.randint(1, 3)) if rng.random() < 0.3 else other)
    want = groups(range(len(texts)), similar(texts))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(10_000 + k, " ".join(base)) for k in range(20)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_copies.similar_documents(docs).collect()}
    linked = {k for k, c in want.items() if sum(v == c for v in want.values()) > 1}
    assert len(set(want.values())) > 50  # many that no link connects to the rest
    assert all(want[k] == want[got[k]] for k in got if k < 10_000 and got[k] < 10_000)  # nothing is joined that links don't join
    assert len([k for k in linked if got.get(k) == want[k]]) >= 0.97 * len(linked)
    assert {got[10_000 + k] for k in range(20)} == {got[0]}


def test_links_within_chunks():
    rng = random.Random(8)
    base = words(rng, 60)
    texts = [base] + [edited(rng, rng.choice([base, words(rng, 60)]), rng.randint(0, 3)) for _ in range(60)] + [[]]
    pool = {}
    sets = [np.array(sorted({pool.setdefault(tuple(t[i:i + 5]), len(pool) * 2**40) for i in range(len(t) - 4)}), "u8") for t in texts]
    want = groups(range(len(texts)), similar(texts[:-1]))
    done = np.array([want[k] == want[0] for k in range(len(texts))]) & (np.arange(len(texts)) % 2 == 0)
    links = near_copies.links_within(np.arange(len(texts)), sets, done, None)
    assert groups(range(len(texts)), links + [(0, int(k)) for k in np.flatnonzero(done)]) == want
    side = np.arange(len(texts)) % 3 == 0
    assert all(side[a] != side[b] for a, b in near_copies.links_within(np.arange(len(texts)), sets, done & False, side))


def test_tables_grow_with_the_texts():
    assert near_copies.tables_for(1000) == near_copies.Tables(10, 24) and near_copies.tables_for(1000).limit == 56
    wider = near_copies.tables_for(50_000_000)
    assert wider.width == 32 and wider.segments > 20 and 64 * wider.words >= wider.segments * wider.width


def test_wider_tables_find_the_same(spark):
    rng = random.Random(3)
    bases = [words(rng, 200) for _ in range(30)]
    rows = [(2 * k, " ".join(b)) for k, b in enumerate(bases)] + [(2 * k + 1, " ".join(edited(rng, b, 2))) for k, b in enumerate(bases)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.similar_documents(docs, tables=near_copies.tables_for(10**9)).collect()}
    assert got == {k: k // 2 * 2 for k in range(60)}


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 64)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 64)).astype("f4")
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(base)]
    for k in range(40):
        for j in range(3):
            v = base[k] + rng.standard_normal(64).astype("f4") * (0.05, 0.12, 0.3)[j]
            rows.append((100 + 10 * k + j, v.tolist(), k % 3))
    rows += [(600 + k, (base[0] * (1 + k)).tolist(), 0) for k in range(3)] + [(700, base[0].tolist(), 0), (701, base[0].tolist(), 1)]
    hot = rng.standard_normal(64)
    rows += [(2000 + k, (hot + rng.standard_normal(64) * 0.03).tolist(), 2) for k in range(300)]  # more than one chunk
    odd = [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] * 64, 0), (904, base[0].tolist(), None), (905, [1.0, 2.0], 0), (906, [], 0), (None, base[0].tolist(), 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1)).withColumn("keys", F.lit("x"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()}
    ids, x, label = [r[0] for r in rows], np.array([r[1] for r in rows], "f4").astype("f8"), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(same, False)
    want = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(same))])
    for k, i in enumerate(ids):
        assert got[i] == (int(same[k].sum()), want[i], want[i] == i)
    for i, *_ in odd[:-1]:
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True) and len(got) == len(rows) + len(odd)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("kind, labels", [("string", ["a", "b", ""]), ("double", [float("nan"), 0.5, 1e300]), ("array<string>", [["a", "b"], ["a, b"], []]), ("int", [-1, 0, 7])])
def test_parts_are_of_one_label_and_length(spark, kind, labels):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((6, 8))
    near = lambda v: (v + 0.005 * rng.standard_normal(8)).tolist()
    rows = [(6 * k + 100 * copy + i, near(v), label) for k, label in enumerate(labels) for copy in range(3) for i, v in enumerate(base)]
    rows += [(1000 + i, v[:5].tolist(), labels[0]) for i, v in enumerate(base)]  # other lengths among them
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert {i: got[i] for i, _, _ in rows if i < 1000} == {i: (2, i % 100) for i, _, _ in rows if i < 1000}
    assert all(got[1000 + i] == (0, 1000 + i) for i in range(6))
