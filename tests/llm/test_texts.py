"""Toxicity, quality, licences, languages and chat against plain rules and held-out texts."""

import collections
import hashlib
import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
import zlib
from pyspark.sql import functions as F

from circuitscope.llm import chat, langid, licenses, quality, toxicity
from circuitscope.llm.words import IN_LETTERS, find_words, hash_words, slices


def test_words_against_split():
    texts = ["a bb  ccc", None, "", " \x0b\x0cé x\r\n", "tail", "x" * 5000, "a b", "ab"]
    for table, pattern in ((None, rb"[^\x20\x09-\x0D]+"), (IN_LETTERS, rb"[A-Za-z\x80-\xff]+")):
        seen = collections.defaultdict(set)
        for first, part in slices(pa.array(texts)):
            words = find_words(part) if table is None else find_words(part, table)
            got = [part.data[a:b].tobytes() for a, b in zip(words.starts, words.ends)]
            assert got == [w for t in texts for w in re.findall(pattern, (t or "").encode())]
            for w, h in zip(got, hash_words(part, words)):
                seen[w].add(int(h))
        assert all(len(h) == 1 for h in seen.values()) and len({next(iter(h)) for h in seen.values()}) == len(seen)


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best one, then what is left and right of it."""
    sums = np.concatenate([[0], np.cumsum(scores)])

    def best(a, b):
        found = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sums[j] - sums[i]
                if s > 1e-12 and (found is None or s > found[2] + 1e-9):
                    found = (i, j - 1, s)
        if found is None:
            return []
        return best(a, found[0]) + [found] + best(found[1] + 1, b)

    return best(0, len(scores))


def test_maximal_segments_by_definition():
    rng = random.Random(1)
    for _ in range(150):
        scores = np.array([rng.choice([-3.1, -1.7, -0.9, 0.73, 1.31, 2.9]) + rng.random() * 0.01 for _ in range(rng.randint(0, 14))])
        got = toxicity.maximal_segments(np.flatnonzero(scores > 0), scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute_segments(scores)]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    clean = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    bad = ["vilewordone", "nastytwo", "horridthree"]
    rows, labels = [], []
    for k in range(1200):
        words = rng.choices(clean, k=rng.randint(5, 120))
        toxic = int(k % 5 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words).capitalize()))
        labels.append((k, toxic, int(k % 7 > 0)))
    rows += [(5000, None), (5001, ""), (5002, "word " * 50_000), (None, "vilewordone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("__note", F.lit(1))
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out(spark, labelled):
    docs, labels = labelled
    got = toxicity.predict(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert by_id[5000].score == by_id[5001].score < 0.3 and by_id[5000].passages == [] and 0 <= min(r.score for r in got) <= max(r.score for r in got) <= 1
    found = next(r for r in held if r.doc_id % 5 == 0 and r.passages)
    text = docs.where(F.col("doc_id") == found.doc_id).first().text.lower().split()
    p = found.passages[0]
    assert set(text[p.first_word:p.first_word + p.words]) & {"vilewordone", "nastytwo", "horridthree"}
    kept = toxicity.keep_clean(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_calibration_is_steady():
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < 0.1).astype("f8")
    for noise in (0.0, 0.02):  # without noise the classes can be told apart
        hit = np.where(rng.random(4000) < noise, 1 - y, y)
        x = np.column_stack([hit * rng.uniform(2, 4, 4000), hit * rng.uniform(1, 100, 4000)])
        w, _ = toxicity._calibrate(x, y)
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        assert np.isfinite(w).all() and np.abs(w).max() < 100 and np.mean((p >= 0.3) == (hit == 1)) > 0.99


def test_toxicity_without_labels_or_rows(spark, labelled):
    docs, labels = labelled
    assert {r.predicted for r in toxicity.predict(docs.where("doc_id < 20"), labels.limit(0)).collect()} == {0}
    assert toxicity.predict(docs.limit(0), labels.limit(0)).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules_and_verdicts(spark):
    rng = random.Random(3)
    good = ["".join(rng.choices("abcdef", k=4)) for _ in range(150)]
    junk = ["".join(rng.choices("XYZ%$", k=3)) for _ in range(30)]
    rows = [(k, " ".join(rng.choices(junk if k % 6 == 0 else good, k=rng.randint(60, 200)))) for k in range(600)]
    odd = [(900, None), (901, ""), (902, "a b c a b c a b c\nx\nx\n \n \n<#|>"), (903, "same three words " * 40), (904, "é x # & ' " * 30), (905, "w " * 30_000), (905, "w"), (None, "ok")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("kept", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k % 6 > 0)) for k in range(600)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = quality.quality(docs, labels).collect()
    assert sorted(plain_counts(t) for _, t in rows + odd) == sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in got)
    scored = [r for r in got if r.doc_id is not None and r.doc_id < 600 and not r.base_failed]
    assert all(r.kept == (r.doc_id % 6 > 0) for r in scored) and not any(r.kept for r in got if r.base_failed)
    fewer = quality.quality(docs, labels.where("doc_id % 4 > 0")).where("doc_id % 4 = 0 and not base_failed").collect()
    assert len(fewer) > 100 and all(r.kept == (r.doc_id % 6 > 0) for r in fewer)
    assert all(r.kept != r.base_failed for r in quality.quality(docs, labels.limit(0)).collect())
    assert quality.quality(docs.limit(0), labels.limit(0)).count() == 0


def test_log_ratios_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a")], "doc_id long, text string")
    counts = {tuple(r)[1:] for r in quality.corpus_counts(docs, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    assert counts == {(3, 2), (1, 0), (1, 1)}  # a; b and the pair a b; the pair a a


def test_quality_ratios_and_scores_by_plain_rules(spark):
    """Each n-gram's bucket comes from a text of it alone; all sums and logs are made again from the words."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(1, 30)))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grams = {k: t.split() + list(zip(t.split(), t.split()[1:])) for k, t in rows}

    def bucket(gram):
        _, part = next(iter(slices(pa.array([gram if isinstance(gram, str) else " ".join(gram)]))))
        words = find_words(part)
        return int(quality.ngrams(words, hash_words(part, words))[0][-1])  # the pair comes behind the words

    place = {g: bucket(g) for g in set().union(*grams.values())}
    raw, target = (collections.Counter(place[g] for k in grams if k % 3 == 0 or all_of for g in grams[k]) for all_of in (True, False))
    trusted = spark.createDataFrame([(k,) for k in grams if k % 3 == 0], "doc_id long")
    ratios = quality.log_ratios(quality.corpus_counts(docs, trusted))
    n, m = quality.BUCKETS, quality.PRIOR
    for b in range(0, n, 997):
        raw.setdefault(b, 0)
    for b in raw:
        share = (raw[b] + 1) / (sum(raw.values()) + n)
        assert abs(np.log((target[b] + m * share) / (sum(target.values()) + m) / share) - ratios[b]) < 1e-5
    for r in quality.score(docs, ratios).collect():
        assert abs(r.score - np.mean([ratios[place[g]] for g in grams[r.doc_id]])) < 1e-6
    assert not quality.log_ratios(quality.corpus_counts(docs, trusted.limit(0))).any()


def test_quality_threshold_by_trying_all_cuts():
    rng = random.Random(9)
    for _ in range(200):
        good, bad = ([rng.randint(a, a + 12) / 8 for _ in range(rng.randint(1, 9))] for a in (4, 0))
        cut = quality.threshold(np.array(good), np.array(bad), 0.25)
        errors = lambda c: (sum(g < c for g in good) / len(good), sum(b >= c for b in bad) / len(bad))
        allowed = [sum(errors(c / 16)) for c in range(-1, 30) if errors(c / 16)[0] <= 0.25]
        assert errors(cut)[0] <= 0.25 and abs(sum(errors(cut)) - min(allowed)) < 1e-9
    assert quality.threshold(np.array([]), np.array([1.0])) == quality.threshold(np.array([1.0]), np.array([])) == quality.MIN_SCORE


def test_quality_learns_from_every_label(spark):
    labels = spark.range(60000).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality")
    assert quality.trusted_ids(labels).count() + quality.judged_ids(labels).count() == 60000 and quality.trusted_ids(labels).count() > 30000


def test_quality_shuffles_no_text(spark, monkeypatch):
    """Labels beyond Spark's own limit of a broadcast: sums and scores are shuffled, texts only for ids beyond MAX_SENT."""
    rows = [(k, f"a{k % 7} b{k % 5} " * 40) for k in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(300)], "doc_id long, quality int")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        plan = lambda: quality.corpus_counts(docs, quality.trusted_ids(labels))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan() and "SortMergeJoin" not in plan()
        want = sorted(map(tuple, quality.quality(docs, labels).collect()))
        monkeypatch.setattr(quality, "MAX_SENT", 10)
        assert "SortMergeJoin" in plan() and sorted(map(tuple, quality.quality(docs, labels).collect())) == want
    finally:
        spark.conf.set(limit, before)


def test_quality_judges_by_rows_that_it_did_not_count(spark):
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(400)] + [(7, 0, "x"), (None, 1, "x"), (401, None, "x")], "doc_id long, quality int, text string")
    counted, judged = {r.doc_id for r in quality.trusted_ids(labels).collect()}, dict(quality.judged_ids(labels).collect())
    assert not counted & set(judged) and counted | set(judged) == set(range(400)) and judged.get(7, 1) == 1
    assert all(q == k % 2 for k, q in judged.items()) and 20 < sum(judged.values()) < 80


def test_languages(spark):
    rng = random.Random(8)
    parts = {"en": "the ing tion and er wh sh ly".split(), "fr": "eau é oi que eux ç le è".split(), "ru": ["при", "вет", "ов", "ско", "ние"]}
    sentence = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, sentence(lang, rng.randint(4, 60)), lang) for k in range(600) for lang in [("en", "fr", "ru")[k % 3]]]
    mixed = sentence("en", 40) + " " + sentence("ru", 30) + " " + sentence("fr", 20)
    odd = [(900, None, "en"), (901, "", None), (902, "123 !?", "fr"), (903, mixed, None), (904, sentence("fr", 20_000), None), (None, sentence("en", 9), "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in langid.predict(docs).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 600]
    assert held and np.mean([r.lang_pred == ("en", "fr", "ru")[r.doc_id % 3] for r in held]) > 0.97
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[900].spans == [] and got[900].score == 0
    assert [(s.lang, s.words) for s in got[903].spans] == [("en", 40), ("ru", 30), ("fr", 20)] and got[904].lang_pred == "fr"
    kept = langid.keep_identified(docs, langid.train(docs))
    assert kept.columns == docs.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()})
    assert {r.lang_pred for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(docs.limit(0)).count() == 0


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    for n in range(1, 7):
        scores = rng.normal(0, 3, (n, 3)).astype("f4")
        total = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(total, itertools.product(range(3), repeat=n)))
        assert total(langid.viterbi(scores, np.array([n]), 2.0)) == pytest.approx(best, abs=1e-4)
    both = np.concatenate([scores, scores[:2]])
    assert langid.viterbi(both, np.array([6, 0, 2]), 2.0).tolist() == [*langid.viterbi(scores, np.array([6]), 2.0), *langid.viterbi(scores[:2], np.array([2]), 2.0)]


def test_licences(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "x\n" + mit.replace("merge, ", "").upper() + "\ny"), (3, "This work is licensed under the GNU General Public License, version 3."),
            (4, "This work is licensed under the GNU General Public License, version 2."), (5, "we talk about a licence and a copyright here"), (6, None), (7, ""),
            (8, "Licensed under CC BY-NC 4.0.\n" + "\n" * 9 + "All rights reserved."), (9, "word " * 100_000 + "\nReleased under the MIT License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("findings", F.lit(1))
    got = {r.doc_id: r.findings for r in licenses.scan(docs).collect()}
    names = {k: [f.license for f in v] for k, v in got.items()}
    assert names == {1: ["MIT"], 2: ["MIT"], 3: ["GPL-3.0"], 4: ["GPL-2.0"], 5: [], 6: [], 7: [], 8: ["CC-BY-NC-4.0", "Proprietary"], 9: ["MIT"]}
    assert got[2][0].missing == ["merge"] and got[2][0].added == [] and got[1][0].first_line == 1
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_notice_of_a_line(spark):
    gpl, mit = licenses.TEMPLATES["GPL-3.0/line"], "Released under the MIT License."
    apache = licenses.TEMPLATES["Apache-2.0"].replace("governing", "concerning")
    rows = [(1, "All rights reserved. " + gpl), (2, f"{mit} {mit}"), (3, mit + " in the end " + "of a word the " * 50 + gpl), (4, apache),
            (5, "the program and the terms of the text " * 40 + licenses.TEMPLATES["GPL-3.0"].replace("the GNU", "a GNU") + " the end of the text" * 40)]
    got = {r.doc_id: r.findings for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: [f.license for f in v] for k, v in got.items()} == {
        1: ["Proprietary", "GPL-3.0"], 2: ["MIT", "MIT"], 3: ["MIT", "GPL-3.0"], 4: ["Apache-2.0"], 5: ["GPL-3.0"]}
    assert (got[4][0].missing, got[4][0].added) == (["governing"], ["concerning"])
    assert (got[5][0].missing, got[5][0].added) == (["the"], ["a"])


def test_notices_in_any_wrapping(spark):
    templates = licenses.TEMPLATES
    prose = "some words of the text stand about it and are of no matter to the scan "
    rows, names, k = [], {}, 0
    for name, text in templates.items():
        for width, mark in ((20, ""), (60, " * "), (72, ""), (79, "# ")):
            lines = "\n".join(mark + line for line in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))
            rows.append((k, (prose + "\n") * 30 + "\n" + lines + "\n\n" + (prose + "\n") * 30))
            names[k] = name.split("/")[0]
            k += 1
    got = {r.doc_id: r.findings for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: [(f.license, f.first_line, f.share, f.missing, f.added) for f in v] for k, v in got.items()} == {
        k: [(name, 31, 1.0, [], [])] for k, name in names.items()}


def test_deciding_words_and_clauses(spark):
    line, bsd2, bsd3 = licenses.TEMPLATES["GPL-3.0/line"], licenses.TEMPLATES["BSD-2-Clause"], licenses.TEMPLATES["BSD-3-Clause"]
    numbered = bsd3.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither")
    gpl2 = licenses.TEMPLATES["GPL-2.0"]
    rows = [(1, line.replace("3", "4")), (2, gpl2), (3, gpl2.replace("GNU General", "GNU Lesser General")), (4, bsd2), (5, numbered), (6, licenses.TEMPLATES["MIT"]),
            (7, gpl2.replace("version 2", "version 5")), (8, "Licensed under CC BY-ND 4.0."), (9, gpl2 + "\n" + gpl2), (10, "words without any of them " * 9)]
    got = {r.doc_id: [f.license for f in r.findings] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: ["GPL-2.0"], 3: [], 4: ["BSD-2-Clause"], 5: ["BSD-3-Clause"], 6: ["MIT"], 7: [], 8: [], 9: ["GPL-2.0"] * 2, 10: []}


def common_length(a, b):
    """The most words of two lists in the same order."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_every_template_against_every_window():
    """A place of brute force: a window, no longer than twice a template, with MIN_SHARE of its words in order and nothing decisive changed."""
    rng = random.Random(14)
    templates = {n: t for n, t in licenses.TEMPLATES.items() if len(t.split()) < 30}
    scanner = licenses.Scanner(templates)
    for _ in range(60):
        name = rng.choice(sorted(templates))
        words = licenses._WORD.findall(templates[name].lower())
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 1)] = [rng.choice(["of", "other", "4", "the"])] if rng.random() < 0.6 else []
        text = ["prose"] * rng.randint(0, 4) + words + ["more"] * rng.randint(0, 4)
        worth = {}
        for n, wanted in scanner.words.items():
            for a in range(len(text)):
                for b in range(a + 1, min(len(text), a + 2 * len(wanted)) + 1):
                    part = text[a:b]
                    if part[0] not in wanted or part[-1] not in wanted or (same := common_length(wanted, part)) < licenses.MIN_SHARE * len(wanted):
                        continue
                    if scanner.confirmed(n, part):
                        worth[n] = max(worth.get(n, -99), 3 * same - len(wanted) - len(part))
        got = scanner.scan(" ".join(text))
        assert bool(got) == bool(worth)
        if got:
            assert got[0]["license"] in {n.split("/")[0] for n in worth}
            assert worth[max(worth, key=worth.get)] == max(v for n, v in worth.items() if n.split("/")[0] in {f["license"] for f in got})


def test_chat_round_trip_and_masks(spark):
    nasty = ["<|end|>", "a<|turn|>b\\c\\.", "<|text|><|text|>", "<<|end|>", "\\", "\n", "", None, "<|", "|end|>", "</s>[INST] ok [/INST]"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(nasty + ["last"])]
    rows += [(2, 0, "assistant", "no"), (3, 0, "user", "q"), (4, 0, "system", "s"), (4, 1, "user", "q"), (4, 2, "assistant", "a"), (5, 1, None, "x"), (5, 1, None, "x"), (None, 0, "user", "u"), (6, None, "to<|end|>ol", "t")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_conversations(table).withColumn("f", chat.formatted_text()).withColumn("turns", chat.read_turns(F.col("f"))).withColumn("loss", chat.loss_text())
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:12]]
    assert got[1].loss == "".join(r[3] or "" for r in rows[:12] if r[2] == "assistant")
    assert [(t.role, t.text) for t in got[5].turns] == [("", "x"), ("", "x")] and got[6].turns[0].role == "to<|end|>ol"
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, None: False, 6: False}
    assert got[2].problem == "turn 1: assistant after start" and got[3].problem == "ends after user"
    assert chat.format_conversations(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(open="aba")
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_other_templates_keep_texts_apart(spark):
    template = chat.Template(open="[INST]", body="<body>", close="</s>")
    rows = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(rows, template).withColumn("t", chat.read_turns(chat.formatted_text(), template)).withColumn("l", chat.loss_text()).first()
    assert [x.text for x in r.t] == ["</s>[INST] ok [/INST]"] * 2 and r.l == "</s>[INST] ok [/INST]"
    assert hashlib.sha256(r.l.encode()).hexdigest() == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def thue_morse(doublings):
    a, b = "a", "b"
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


def test_words_of_equal_letter_sums_have_different_hashes():
    from circuitscope.llm.words import find_words, hash_words, slices

    words = [w for k in range(3, 17) for w in thue_morse(k)] + ["a" * k for k in range(1, 40)] + ["abcdefgh12345678", "12345678abcdefgh"]
    (_, texts), = slices(pa.array([" ".join(words), "é " + " ".join(words[::-1])]), size=1 << 30)
    found = find_words(texts)
    hashes = hash_words(texts, found).tolist()
    assert len(set(hashes[:len(words)])) == len(set(words))
    assert hashes[:len(words)] == hashes[len(words) + 1:][::-1]  # whatever stands about a word


def test_quality_counts_of_such_words(spark):
    a, b = thue_morse(10)
    other = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, f"x {a} y x {b} y {other}"), (2, f"x {a} y x {a} y {other}")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_repeat_words for r in quality.quality(docs, labels).collect()} == {1: 0, 2: 6}


def test_letters_of_other_scripts_and_punctuation(spark):
    texts = ["Das ist\u2014gut \u201cso\u201d \u00fcber\u00bbx\u00ab", "\u65e5\u672c text\u6f22abc\u3002\u304b", "", None, "\u00b5m 5\u00d73 \u00e9t\u00e9", "\U0001f600smile \ud55c\uad6d\uc5b4", "ab"]
    (_, part), = slices(pa.array(texts))
    words = langid.find_letters(part)
    got = [[part.data[a:b].tobytes().decode() for a, b, t in zip(words.starts, words.ends, words.text) if t == i] for i in range(len(texts))]
    assert got == [["Das", "ist", "gut", "so", "\u00fcber", "x"], ["\u65e5", "\u672c", "text", "\u6f22", "abc", "\u304b"], [], [], ["\u00b5m", "\u00e9t\u00e9"],
                   ["smile", "\ud55c\uad6d\uc5b4"], ["ab"]]
    assert words.counts.tolist() == [len(x) for x in got]
    docs = spark.createDataFrame([(k, "\u65e5\u672c\u8a9e" * 20, "ja") for k in range(40)] + [(100 + k, "the plain words of it " * 5, "en") for k in range(40)]
                                 + [(200, "the plain words" + "\u65e5\u672c\u8a9e" * 5 + "of it and the words", None), (201, "\u2102", None), (202, "\u2014 5", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in langid.predict(docs).collect()}
    assert [s.lang for s in rows[200].spans] == ["en", "ja", "en"] and rows[202].lang_pred == "und" and (rows[201].lang_pred, rows[201].score) == ("en", 0.0)


def test_compression_chooses_among_wordings_that_the_differences_allow(monkeypatch):
    common = "permission is granted to copy and keep this work in any form for every reader who asks"
    templates = {"a-first": common + " while supplies hold", "b-second": common + " until doors open"}
    text = "Preface of the book. " + templates["b-second"] + " Chapter one."
    assert [x["license"] for x in licenses.Scanner(templates).scan(text)] == ["b-second"]
    monkeypatch.setattr(licenses.Scanner, "reduction", lambda self, name, raw: 1.0)
    assert [x["license"] for x in licenses.Scanner(templates).scan(text)] == ["a-first"], "without compression nothing tells them apart"
    monkeypatch.setattr(licenses.Scanner, "reduction", lambda self, name, raw: 0.0)
    assert licenses.Scanner(templates).scan(text) == [], "what shortens nothing is no candidate"


def test_templates_are_ranked_by_what_they_save():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, template in licenses.TEMPLATES.items():
        best = scanner.ranked(licenses.TEMPLATES, template.lower())[0]
        assert best == name or scanner.reduction(best, template.lower()) == scanner.reduction(name, template.lower()), "only one that holds the whole template saves as much"
