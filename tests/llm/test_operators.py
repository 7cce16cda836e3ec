import html
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import anomaly, contamination, elias_fano, html_main, language_model, line_dedup, minhash, packing, quality, stats, store, suffixes, textkit, unit_dedup
from tests.llm import brute
from tests.llm.conftest import SCHEMA

tokenizers = pytest.importorskip("public_tokenizers")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- near-duplicate documents


def as_components(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_near_duplicates_equal_brute_force(frame, corpus):
    out = minhash.near_duplicates(frame(corpus)).cache()
    assert as_components(out) == brute.components(corpus)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_near_duplicates_link_documents_that_the_pivot_rejects(frame):
    """A chain: neighbours are linked, the ends are not, and all are one component."""
    words = [f"w{i}" for i in range(400)]
    chain = [(k, " ".join(words[20 * k : 20 * k + 200])) for k in range(8)]
    far = [(100 + k, " ".join([f"u{k}x{i}" for i in range(60)] + words[:150])) for k in range(5)]
    assert as_components(minhash.near_duplicates(frame(chain + far))) == brute.components(chain + far)


def test_near_duplicates_around_a_pivot_that_rejects_many(frame):
    """Copies of one text with few to many edits, and a second crowd that is far from the first pivot."""
    rng = random.Random(3)
    base, other = [f"w{i}" for i in range(90)], [f"w{i}" for i in range(60)] + [f"v{i}" for i in range(60)]

    def copy(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        return " ".join(words)

    docs = [(k, copy(base, k % 12)) for k in range(150)] + [(200 + k, copy(other, k % 4)) for k in range(40)]
    want = brute.components(docs)
    assert 20 < len({c for _, c in want.values()}) < 150
    assert as_components(minhash.near_duplicates(frame(docs))) == want


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark, frame):
    assert minhash.near_duplicates(empty(spark)).count() == 0
    out = minhash.near_duplicates(frame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (2, "a b c d e f")]))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_near_duplicates_tell_rows_of_one_id_by_their_texts(frame):
    """Id 5 stands with a text that is like id 1's and with one that is like id 3's."""
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(5, one), (5, two), (1, one + " more"), (3, two + " more"), (7, "alone here")]
    for parts in (1, 4):
        got = sorted(tuple(r) for r in minhash.near_duplicates(frame(docs, parts)).collect())
        assert got == [(1, 57, 1, True), (3, 57, 3, True), (5, 56, 1, False), (5, 56, 3, False), (7, 1, 7, True)]


def test_components_are_the_smallest_ids_reachable(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in store.components(edges).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100, 103: 100}


# ---- lines, units, strings


@pytest.mark.parametrize("first", [4, 1])
def test_line_dedup_equals_brute_force(frame, corpus, first, monkeypatch):
    monkeypatch.setattr(line_dedup, "WINDOW", first)
    monkeypatch.setattr(line_dedup, "FIRST_ROUND", first)
    monkeypatch.setattr(line_dedup, "SECOND_ROUND", 2 * first)
    want = brute.later_lines(corpus)
    rows = line_dedup.deduplicate(frame(corpus), bucket_bytes=1 << 12).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in rows} == {i: want[i] for i, _ in corpus}
    texts = dict(corpus)
    for r in rows:
        left = [x for k, x in enumerate((texts[r["doc_id"]] or "").split("\n")) if k not in r["removed_lines"]]
        assert r["kept_text"] == "\n".join(left)


def test_line_dedup_of_short_lines_equals_brute_force(frame, corpus):
    long = "https://example.org/" + "x" * 200
    docs = corpus + [(300 + k, "\n".join(x)) for k, x in enumerate([["a", "b A", "a b c", long], ["A a", "c b a", "a b d", "a b"], [long, "é", "x y z w", "w z y"], ["é", "x y z w v", "Y z w"]])]
    want = brute.later_lines(docs, least=1)
    assert sum(map(len, want.values())) > sum(map(len, brute.later_lines(docs).values()))
    rows = line_dedup.deduplicate(frame(docs), least=line_dedup.EVERY, bucket_bytes=1 << 12).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in rows} == {i: want[i] for i, _ in docs}


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_partners_are_the_earlier_lines_that_pass_the_filters(monkeypatch, chunk):
    monkeypatch.setattr(line_dedup, "PAIRS", chunk)
    rng = np.random.default_rng(4)
    size = 400
    word, n, rank = np.sort(rng.integers(0, 9, size)), rng.integers(2, 30, size), rng.permutation(size)
    pos = (rng.random(size) * np.minimum(n, 8)).astype(np.int64)
    by = np.lexsort((rank, pos, n, word))
    word, n, pos, rank = word[by], n[by], pos[by], rank[by]
    got = sorted((int(i), int(k)) for a, lo, hi in line_dedup.partners(word, n, pos, rank, line_dedup.places(word, n, pos, rank), 80) for i, x, y in zip(a, lo, hi) for k in range(x, y))
    want = [(i, k) for i in range(size) for k in range(size) if word[i] == word[k] and rank[k] < rank[i] and 100 * min(n[i], n[k]) >= 80 * max(n[i], n[k]) and min(n[i] - pos[i], n[k] - pos[k]) >= -(-80 * (n[i] + n[k]) // 180)]
    assert got == want and want


def test_packed_ids_come_back():
    for ids in ([], [0], [5, 6, 7, 1_000_000], [3, -(2**63), 2**63 - 1, 0, 0], list(range(2_000))):
        assert line_dedup._unpacked(line_dedup._packed(np.array(ids, np.int64))).tolist() == ids


def test_a_template_with_own_words_costs_no_comparison():
    """Lines of four words that all have and one of their own share a prefix word but can't be similar."""
    size = 50_000
    x = np.zeros(size, np.int64), np.full(size, 5), np.ones(size, np.int64), np.arange(size)
    assert sum(int((hi - lo).sum()) for _, lo, hi in line_dedup.partners(*x, line_dedup.places(*x), 80)) == 0


def test_templated_lines_stay_and_their_copies_go(frame):
    docs = [(i, "\n".join(f"posted by admin in {i}x{k}" for k in range(30))) for i in range(40)] + [(90, "posted by admin in 3x7\nPosted by admin in  4x4")]
    rows = line_dedup.deduplicate(frame(docs), least=line_dedup.EVERY, bucket_bytes=1 << 12).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {i: 0 for i in range(40)} | {90: 2}


def test_prefixes_of_many_parts_share_a_cell(frame):
    """A cell for each bucket and part of 1 MB would make cells grow with the square of the input."""
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(100_000))) for i in range(4)]
    dealt = line_dedup.prefixes(frame(docs, 1).select("doc_id", "text"), np.zeros(line_dedup.SLOTS, np.uint32), 80, 1, 1)
    assert [r["n"] for r in dealt.groupBy(dealt.marks.isNull().alias("lines")).agg(F.count("*").alias("n")).orderBy("lines").collect()] == [1, 4]


def test_marks_come_back_folded():
    rng = np.random.default_rng(3)
    n, marks = np.array([1, 64, 65, 128, 129, 400]), rng.integers(0, 2**63, (6, 4)).astype(np.uint64)
    cell = line_dedup._marked(marks, n)
    back = line_dedup._marks(cell, n)
    assert len(cell) == 8 * (1 + 1 + 2 + 2 + 4 + 4) and (back[4:] == marks[4:]).all()
    assert (back[2:, :2] ^ back[2:, 2:] == marks[2:, :2] ^ marks[2:, 2:]).all()
    assert (np.bitwise_xor.reduce(back, axis=1) == np.bitwise_xor.reduce(marks, axis=1)).all()


@pytest.mark.parametrize("size", [1, 3])
def test_line_dedup_in_small_pieces_equals_brute_force(frame, corpus, size, monkeypatch):
    """A family of near lines is paired and leaves its task piece by piece, whatever its size; no line's pairs are torn apart."""
    rng = np.random.default_rng(5)
    a = np.repeat(np.arange(20), rng.integers(1, 5, 20))
    pieces = list(line_dedup._together(iter([(a, a, a)]), size))
    assert np.concatenate([p[0] for p in pieces]).tolist() == a.tolist()
    assert all(len(set(p[0])) <= size for p in pieces) and sum(len(set(p[0])) for p in pieces) == 20
    monkeypatch.setattr(line_dedup, "TOGETHER", size)
    monkeypatch.setattr(line_dedup, "LEAVING", size)
    want = brute.later_lines(corpus)
    rows = line_dedup.deduplicate(frame(corpus), bucket_bytes=1 << 12).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in rows} == {i: want[i] for i, _ in corpus}


def test_line_dedup_of_nothing_and_of_repeated_rows(spark, frame):
    assert line_dedup.deduplicate(empty(spark)).count() == 0
    out = line_dedup.deduplicate(frame([(1, "a b c d\na b c d"), (1, "a b c d\na b c d"), (None, "a b c d")]))
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_removed"]) for r in out.collect()) == [("1", 2, 1), ("1", 2, 1), ("None", 1, 0)]


def test_units_keep_the_earliest_and_their_offsets(spark, frame):
    docs = [(2, "a b c d\nfresh line of words\nA  b c D"), (1, "x\na b c d"), (3, None), (4, ""), (5, "x\nx"), (None, "x")]
    got = {r["doc_id"]: (r["n_units"], r["removed_spans"], r["kept_text"]) for r in unit_dedup.deduplicate(frame(docs)).collect()}
    assert got == {1: (2, "", "x\na b c d"), 2: (3, "0-8,28-36", "fresh line of words\n"), 3: (0, "", ""), 4: (0, "", ""), 5: (2, "0-2,2-3", "")}
    assert unit_dedup.deduplicate(empty(spark)).count() == 0


def test_units_of_every_kind_and_rows_that_repeat(frame):
    docs = [(1, "p q r\n\ns t\nu\n\nv"), (2, "new\n\nS t\nu\n\nv w"), (2, "new\n\nS t\nu\n\nv w"), (3, "new\n\nother")]
    got = [tuple(r) for r in unit_dedup.deduplicate(frame(docs), "paragraph").collect()]
    twice = (2, 3, 1, 1, "5-12", "new\n\nv w")
    assert sorted(got) == [(1, 3, 0, 0, "", docs[0][1]), twice, twice, (3, 2, 1, 1, "0-5", "other")]


@pytest.mark.parametrize("unit,run_words", [("line", 1), ("line", 8), ("sentence", 1), ("sentence", 25), ("paragraph", 3)])
def test_units_equal_brute_force(frame, corpus, unit, run_words):
    long = "Word by word it goes. " * 4000
    docs = corpus + [(400, "one a. two b! three c? four.\n\n\nfive d"), (401, "zero. Two  b! three c? six\tfour.\nfive d"), (402, long), (403, "so. " + long)]
    rows = unit_dedup.deduplicate(frame(docs), unit, run_words).collect()
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], r["removed_spans"], r["kept_text"]) for r in rows}
    assert got == brute.later_units(docs, unit, run_words)
    assert {r["doc_id"]: r["n_later"] for r in rows} == {i: x[1] for i, x in brute.later_units(docs, unit, 1).items()}


def as_repeats(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_suffix_dedup_equals_brute_force(frame, corpus):
    assert as_repeats(suffixes.deduplicate(frame(corpus), bucket_bytes=1 << 13)) == brute.repeats(corpus)


def test_suffix_dedup_of_nothing_repeats_and_nulls(spark, frame):
    assert suffixes.deduplicate(empty(spark)).count() == 0
    text = "".join(chr(97 + (i * i) % 23) for i in range(150))
    rows = suffixes.deduplicate(frame([(1, text), (1, text), (None, text), (2, text[:99]), (3, "q" * 300)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("1", 150), ("1", 150), ("2", 0), ("3", 299), ("None", 127)]


def test_difference_covers_cover():
    for cover, v in ((suffixes.COVER, suffixes.V), (suffixes.SORT_COVER, suffixes.W)):
        assert {int(a - b) % v for a in cover for b in cover} == set(range(v))


@pytest.mark.parametrize("block", [1 << 18, 50])
def test_suffixes_are_ordered_as_by_a_plain_sort(block, monkeypatch):
    """Ranks of the samples, the order of tied suffixes, and the places that are later, with many long ties and zeros in the texts."""
    monkeypatch.setattr(suffixes, "BLOCK", block)
    rng = np.random.default_rng(6)
    shared = [rng.integers(0, 3, 300).astype(np.uint8).tobytes() for _ in range(3)] + [b"\0" * 200, b"ab" * 150]
    texts = [b"".join(shared[int(i)][int(j) :] for i, j in zip(rng.integers(0, 5, 3), rng.integers(0, 90, 3))) for _ in range(12)]
    length, gap, W = 100, 2 * suffixes.W, suffixes.W
    size, start = np.array([len(t) for t in texts]), rng.integers(0, 500, len(texts))
    buf = np.frombuffer(b"".join(t + b"\0" * gap for t in texts), np.uint8)
    raw, first = buf.tobytes(), np.cumsum(size + gap) - size - gap
    of = lambda i, depth: raw[i : i + depth]
    places = [(f + k, (s + k) % W, f + n) for f, s, n in zip(first.tolist(), start.tolist(), size.tolist()) for k in range(n)]
    samples = [(i, end) for i, r, end in places if r in suffixes.SORT_COVER]
    ranks = suffixes.sample_ranks(suffixes._words(buf), *np.array(samples).T, length)
    inner = sorted((of(i, length), ranks[i]) for i, end in samples if i + length <= end)
    assert all((x[0] < y[0]) <= (x[1] < y[1]) for x, y in zip(inner, inner[1:]))
    suffix = [i for i, _, end in places if i + length <= end]
    residue = np.zeros(len(buf), np.int64)
    residue[[p[0] for p in places]] = [p[1] for p in places]
    at = np.array(sorted(suffix, key=lambda i: of(i, W)))
    group = np.cumsum([i > 0 and of(at[i], W) != of(at[i - 1], W) for i in range(len(at))])
    got = [of(i, length) for i in suffixes.order_tied(at, group, residue, ranks)]
    assert got == sorted(got)
    seen, want = set(), []
    for i in suffix:
        if of(i, length) in seen:
            want.append(i)
        seen.add(of(i, length))
    s, e = suffixes.later_places(buf, size, start, size - length + 1, length)
    assert [i for a, b in zip(s, e) for i in range(a, b)] == want


# ---- statistics and models


def test_statistics_equal_brute_force(frame, corpus):
    rows = stats.with_stats(frame(corpus)).collect()
    assert {r["doc_id"]: tuple(r[c] for c in stats.COUNTS) for r in rows} == {i: brute.statistics(t) for i, t in corpus}


@pytest.fixture(scope="module")
def judged(spark, sf_dir):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_is_learned_and_compiled(judged):
    docs, labels = judged
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rows = quality.scored(docs, labels, ~held).filter(held).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= quality.CUT_SCORE) == (r["quality"] == 1) for r in rows]) > 0.95
    x = np.random.default_rng(1).random((500, 4))
    model = quality.fit(x, (x[:, 0] + 0.3 * x[:, 1] > 0.6).astype(int), ["a", "b", "c", "d"])
    spark = docs.sparkSession
    table = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double")
    got = [r[0] for r in table.select(model.column()).collect()]
    assert np.allclose(got, model.score(x)) and 0 < len(model.rules) < 150


def test_quality_without_labels_scores_every_row(spark, frame, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.scored(frame(corpus), labels).collect()} == {0.5}
    assert quality.scored(empty(spark), labels).count() == 0


def test_isolation_forest_keeps_good_and_rejects_odd_documents(judged):
    docs, labels = judged
    rows = anomaly.verdicts(docs, labels).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r["kept"] for r in rows if r["quality"] == 1]) > 0.98
    assert np.mean([r["kept"] for r in rows if r["quality"] == 0]) < 0.2


def test_anomalies_without_labels_follow_the_base_rules(spark, frame, corpus):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = anomaly.verdicts(frame(corpus), labels).collect()
    assert len(rows) == len(corpus) and all(r["kept"] != r["base_failed"] for r in rows)
    assert anomaly.verdicts(empty(spark), labels).count() == 0


def test_forest_and_bound_equal_plain_versions():
    """Path lengths by walking every tree, and the calibrated bound by trying every score."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    x[:12] += 6
    forest = anomaly.Forest(x, trees=20, sample=64)

    def path(tree, row):
        split, bound, child, depth = tree
        at = 0
        while split[at] >= 0:
            at = child[at] + (row[split[at]] > bound[at])
        return depth[at]

    def usual(n):
        return 2 * (sum(1 / k for k in range(1, n)) - (n - 1) / n)

    want = [2 ** (-np.mean([path(t, row) for t in forest.trees]) / usual(64)) for row in x]
    got = forest.score(x)
    assert np.allclose(got, want, atol=2e-3) and got[:12].min() > np.median(got[12:])
    y = np.array([0] * 12 + [1] * 288)
    bound = anomaly.calibrate(got, y, 0.01)
    allowed = [b for b in np.unique(got) if np.mean(got[y == 1] > b) <= 0.01]
    assert np.mean(got[y == 1] > bound) <= 0.011 and (got[y == 0] > bound).sum() == max((got[y == 0] > b).sum() for b in allowed)


def test_trees_are_drawn_and_the_bound_is_set_from_all_labelled_rows(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), *(F.col("id").cast("double").alias(c) for c in anomaly.LOOKED_AT))
    trees = anomaly.drawn(rows, 30_000, 40, 256)
    assert [x.shape for x in trees] == [(256, len(anomaly.LOOKED_AT))] * 40 and all(len(set(x[:, 0])) == 256 for x in trees)
    held = np.concatenate(trees)[:, 0]
    assert len(set(held)) > 8_000 and abs(held.mean() - 15_000) < 400  # 10,240 draws of all rows, a row by several trees now and then
    assert all(np.array_equal(a, b) for a, b in zip(trees, anomaly.drawn(rows.repartition(7), 30_000, 40, 256)))
    assert {len(x) for x in anomaly.drawn(rows.limit(90), 90, 5, 256)} == {90}
    score, y = np.random.default_rng(3).permutation(25_000) / 25_000, np.arange(25_000) % 10 > 0
    bound = anomaly.bound_of(spark.createDataFrame([(float(a), int(b)) for a, b in zip(score, y)], "anomaly double, y int"), 0.003)
    assert math.isclose(bound, anomaly.calibrate(score, y.astype(int), 0.003), rel_tol=1e-12)


def test_rules_are_paths_and_the_lasso_is_at_its_optimum():
    """Every kept rule is a conjunction that holds for some rows; at the optimum no weight's gradient beats the penalty."""
    rng = np.random.default_rng(10)
    x = rng.random((800, 5))
    y = ((x[:, 0] > 0.6) | ((x[:, 1] < 0.3) & (x[:, 2] > 0.5))).astype(int)
    model = quality.fit(x, y, list("abcde"), trees=10, penalty=0.004)
    holds = np.array([[all((row[j] > b) == above for j, above, b in rule) for rule in model.rules] for row in x], float)
    score = 1 / (1 + np.exp(-(model.intercept + holds @ model.weights)))
    assert np.allclose(score, model.score(x)) and np.mean((score > 0.5) == y) > 0.97
    gradient = (holds - holds.mean(0)).T @ (score - y) / len(y)
    assert np.allclose(gradient, -0.004 * np.sign(model.weights), atol=1.5e-3) and abs((score - y).mean()) < 1e-3


def test_models_judge_rows_with_null_and_repeated_ids_and_long_texts(spark, judged):
    _, labels = judged
    long = "plain words stand here in a row. " * 30_000
    rows = [(None, "a b"), (None, None), (3, long), (3, "other text"), (3, "other text"), (4, "")]
    df = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, kept boolean")
    scored = quality.scored(df, labels).collect()
    assert sorted(str(r["doc_id"]) for r in scored) == sorted(str(i) for i, _ in rows) and all(0 <= r["score"] <= 1 for r in scored)
    verdicts = anomaly.verdicts(df, labels).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in verdicts) == sorted((str(i), len(brute.words(t))) for i, t in rows)


def test_the_labelled_sample_is_bounded_before_it_is_sorted(spark):
    table = spark.range(5000).select(F.col("id").alias("doc_id"), *(F.col("id").cast("double").alias(c) for c in stats.RATIOS))
    labels = spark.range(6000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    x, y = stats.labelled(table, labels, 400)
    again, _ = stats.labelled(table.repartition(7), labels, 400)
    assert len(x) == len(y) == 400 and np.array_equal(x, again) and set(y) == {0, 1}
    assert len(stats.labelled(table, labels, 9000)[0]) == 5000


# ---- language model


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (500, 600), (700, 10**9)])
def test_elias_fano_reads_what_was_written(n, top):
    rng = np.random.default_rng(n)
    x = np.unique(rng.integers(0, top, n))
    e = elias_fano.EliasFano(elias_fano.unpack(elias_fano.pack(elias_fano.EliasFano.encode(x))))
    assert (e.access(np.arange(len(x))) == x).all()
    ask = rng.integers(0, top + 9, 300)
    assert (e.successor(ask) == np.searchsorted(x, ask)).all()


def brute_scores(docs, held):
    texts = {i: [*brute.words(t), b"\n"] for i, t in docs}
    c1, c3 = Counter(), Counter()
    for i, w in texts.items():
        if not held(i):
            c1.update(w)
            c3.update(zip([b" ", b" ", *w], [b" ", *w], w))
    n, v = sum(c1.values()), len(c1)
    c2, total2, kinds2, total3, kinds3 = (Counter() for _ in range(5))
    for (a, b, w), k in c3.items():
        c2[b, w] += k
        total3[a, b] += k
        kinds3[a, b] += 1
    for (b, _), k in c2.items():
        total2[b] += k
        kinds2[b] += 1
    d = language_model.DISCOUNT

    def p(a, b, w):
        low = (c1[w] + 0.1) / (n + 0.1 * (v + 1))
        mid = (max(c2[b, w] - d, 0) + d * kinds2[b] * low) / total2[b] if total2[b] else low
        return (max(c3[a, b, w] - d, 0) + d * kinds3[a, b] * mid) / total3[a, b] if total3[a, b] else mid

    return n, {i: (len(w), sum(c1[x] > 0 for x in w), sum(math.log10((c1[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(*g)) for g in zip([b" ", b" ", *w], [b" ", *w], w))) for i, w in texts.items()}


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 500, "shard_tokens": 300, "hot_count": 20}, {"shard_tokens": 50, "hot_count": 5, "batch_tokens": 1}])
def test_scores_equal_brute_force(frame, corpus, sizes):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    n, want = brute_scores(corpus, held)
    rows = language_model.score(frame(corpus), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, **sizes).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    for r in rows:
        tokens, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base) and abs(r["score"] - score) < 5e-4 * tokens


def test_chunks_agree_where_the_first_words_go(spark):
    """The word with a chunk's largest hash is frequent in one chunk, rare in the others."""
    names = [f"v{i}" for i in range(200)]
    h = textkit.word_hashes(*textkit.flat(pa.array([" ".join(names)])))[0]
    names = [names[i] for i in np.argsort(h)]
    rng = np.random.default_rng(5)
    texts = [[(100 * c + k, " ".join([names[k % 3 + 2 * c], *rng.choice(names[c : c + 20], 8), *(more if k == 0 or c == 0 else [])])) for k in range(40)] for c, more in enumerate([[names[-1]] * 6, [names[-2]], [names[-3]]])]
    docs = [x for t in texts for x in t]
    n, want = brute_scores(docs, lambda i: False)
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 3), "doc_id long, text string")
    rows = language_model.score(df, F.lit(False), shard_tokens=100, hot_count=20).collect()
    assert len(rows) == len(docs)
    assert max(abs(r["score"] - want[r["doc_id"]][3]) / r["n_tokens"] for r in rows) < 5e-4


@pytest.mark.parametrize("sizes", [{}, {"bucket_bytes": 500, "shard_tokens": 30, "hot_count": 3}])
def test_scores_of_rows_that_repeat_an_id_or_have_none(spark, sizes):
    big = 2**60 + 1
    rows = [(0, "a b c"), (None, "a b d e"), (None, "held b"), (1, "a b"), (1, "a b"), (1, "b c a a"), (None, None), (big, "c d e"), *[(7, "x y z")] * 4]
    _, want = brute_scores(list(enumerate(t for _, t in rows)), lambda k: (rows[k][1] or "").startswith("held"))
    copies = spark.createDataFrame(spark.sparkContext.parallelize(rows, 6), "doc_id long, text string")  # the last two chunks are the same
    got = language_model.score(copies, F.col("text").startswith("held"), **sizes).collect()
    key = lambda i, held, tokens, known, base, score: (str(i), held, tokens, known, round(base, 6), score)
    got = sorted(key(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got)
    want = sorted(key(i, (t or "").startswith("held"), *want[k]) for k, (i, t) in enumerate(rows))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(x[5] - y[5]) < 5e-4 * x[2] for x, y in zip(got, want))


def test_scores_of_nothing_and_without_training_rows(spark, frame):
    assert language_model.score(empty(spark), F.lit(False)).count() == 0
    assert [(r["n_known"], r["score"]) for r in language_model.score(frame([(1, "a b")]), F.lit(True)).collect()] == [(0, 0.0)]


# ---- contamination and packing


def test_tiling_equals_brute_force_and_finds_reordered_passages(frame, corpus, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "x eta theta iota kappa lambda mu y alpha beta gamma delta epsilon zeta z"
    docs = corpus + [(200, moved), (201, "y " + item.upper() + " z"), (202, "alpha beta gamma delta q epsilon")]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three"), (5, corpus[20][1][:200])], "item_id long, text string")
    texts = {1: item, 4: "one two three", 5: corpus[20][1][:200]}
    docs += [(None, "y " + item), (None, "z"), (201, "no passage here"), (203, "alpha beta gamma delta epsilon " * 700)]
    per_text = {t: [(i, brute.tile_coverage(t, x)) for i, x in texts.items()] for _, t in docs}
    want = sorted(((i, len(brute.words(t)), sum(c >= 0.5 for _, c in per_text[t]), max(c for _, c in per_text[t])) for i, t in docs), key=str)
    for limit in (1 << 20, 0):
        rows = contamination.check(frame(docs), bench, broadcast_bytes=limit).collect()
        got = sorted(((r["doc_id"], r["n_words"], r["n_items"], r["coverage"]) for r in rows), key=str)
        assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want])
        by = {(r["doc_id"], r["n_words"]): r for r in rows}
        assert by[200, 15]["contaminated"] and by[200, 15]["n_tiles"] == 2 and by[None, 13]["contaminated"] and not by[202, 6]["contaminated"]
        assert all(r["item_id"] == min((i for i, c in per_text[dict(docs)[r["doc_id"]]] if c == r["coverage"]), default=None) for r in rows if r["coverage"] and r["doc_id"] not in (None, 201))
        assert contamination.check(empty(spark), bench, broadcast_bytes=limit).count() == 0
        assert not any(r["contaminated"] for r in contamination.check(frame(docs), bench.limit(0), broadcast_bytes=limit).collect())


def test_tiling_of_texts_that_repeat_themselves_in_blocks(monkeypatch):
    monkeypatch.setattr(contamination, "HITS", 7)
    rng = np.random.default_rng(8)
    for _ in range(40):
        a, b = ([f"w{x}" for x in rng.integers(0, 3, n)] for n in (rng.integers(1, 60), rng.integers(1, 30)))
        h = [textkit.word_hashes(*textkit.flat(pa.array([" ".join(x)])))[0] for x in (a, b)]
        found = contamination.tiles(*h, 3)
        assert sum(n for *_, n in found) / len(b) == pytest.approx(brute.tile_coverage(" ".join(a), " ".join(b), 3))
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)


def test_first_fit_decreasing_equals_a_linear_search():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 60, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free, want = [], {}
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(100)
        want[i] = (k, 100 - free[k])
        free[k] -= sizes[i]
    assert all((bins[i], offsets[i]) == want[i] for i in range(300))


def test_packing_holds_every_id_once(spark, frame, corpus):
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    docs = corpus + [(300, "it's,ok. don't... <|endoftext|> É. 1,5.  a. b U.S.A.!! ﬁ İx."), (301, "word " * 9000)]
    docs += [(302, "<|ENDOFTEXT|> <|EndOfText|> a<|endoftext|>B. x<|startoftext|>,<|endoftext|>! <|endoftext|"), (303, "end <|endoftext|>"), (304, "<|endoftext|>\n<|startoftext|>START<|A|> É<|endoftext|>É"), (305, "<| |> <|"), (306, "|>")]
    encode = Tokenizer.from_file(path)
    ids = {i: np.array([*encode.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for i, t in docs}
    rows = packing.pack(frame(docs), path, group_docs=20).collect()
    spans, bins = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]])
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for runs, ends in [(s, len(ids[i])) for i, s in spans.items()] + [(b, None) for b in bins.values()]:
        at = 0
        for start, n in sorted(runs):
            assert start == at and n > 0
            at += n
        assert at == ends if ends is not None else at <= packing.LENGTH
    assert 49407 in ids[300] and 49407 in ids[303] and 49406 in ids[304]
    assert set(spans) == set(ids) and packing.pack(empty(spark), path).count() == 0


# ---- pages


def test_pages_main_text(spark):
    model = html_main.fit(*html_main.labelled_pages(200))
    sources, content = html_main.labelled_pages(80, seed=77)
    wrong = sum(set(t.split("\n\n")) - {""} != c for t, c in zip(html_main.main_texts(sources, model), content))
    assert wrong <= 8
    page = "<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head &amp; more</h1><p>First  text<br>of\n it<p>Second &lt;one&gt;</article><div class='comments'><p>Nice one</p></div><footer>&copy; us</footer></body></html>"
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_main.extract(rows, model).collect()}
    text = "Head & more\n\nFirst text of it\n\nSecond <one>"
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}
    assert html_main.extract(rows.limit(0), model).count() == 0


def test_given_pages_give_their_articles(spark):
    """The article's blocks by a plain reading of the one <article> that the given pages have, and where the model looks for them."""
    blocks = re.compile(r"<(?:p|h[1-6]|li|blockquote|td|pre|div)\b[^>]*>|</(?:p|h[1-6]|li|blockquote|td|pre|div|ul|ol|table|tr)>|<(?:ul|ol|table|tr)\b[^>]*>")

    def plain(source):
        inner = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)[1]
        inner = re.sub(r"<(script|style|aside|form|nav|figure)\b.*?</\1>|<!--.*?-->", "", inner, flags=re.S)
        inner = re.sub(r"<div[^>]*class=\"[^\"]*(?:comment|ad|notice|share|promo)[^\"]*\".*?</div>", "", inner, flags=re.S)
        parts = [" ".join(html.unescape(re.sub(r"<br\s*/?>", " ", x)).split()) for x in blocks.split(inner)]
        return "\n\n".join(" ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts if re.sub(r"<[^>]+>", "", p).strip())

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect() if r["html"] and "<article" in r["html"]}
    got = {r["page_id"]: r["text"] for r in html_main.extract(pages).collect()}
    same = [got[i] == plain(s) for i, s in sources.items()]
    assert len(same) > 10 and np.mean(same) > 0.9


@pytest.mark.parametrize("source,text", [("<div>" * 100_000 + "<p>" + "word " * 50, None), ("<a x" * 100_000, None), ("<p>" + "word " * 30 + "</p>" + "</x>" * 100_000, None), ("<ul>" + "<li>x<div>" * 50_000, None), ("text " * 200_000, " ".join(["text"] * 200_000)), ("<!-- x " * 50_000, "")])
def test_long_nested_and_broken_pages_take_little_time(source, text):
    model = html_main.fit(*html_main.labelled_pages(60), steps=30)
    began = time.process_time()
    (got,) = html_main.main_texts([source], model)
    assert time.process_time() - began < 10 and (text is None or got in (text, ""))


def test_pages_with_repeated_ids_nulls_and_other_columns(spark):
    page = "<article><p>" + "some words of text " * 20 + "</p></article>"
    rows = spark.createDataFrame([(1, page, "a", 5), (1, page, "b", 6), (None, page, None, None), (2, "", "c", 7), (2, None, "c", 7)], "page_id long, html string, text string, n_chars int")
    model = html_main.fit(*html_main.labelled_pages(100), steps=60)
    got = sorted(tuple(map(str, r)) for r in html_main.extract(rows, model).collect())
    text = ("some words of text " * 20).strip()
    assert got == sorted([("1", "None", text, str(len(text)))] * 2 + [("None", "None", text, str(len(text)))] + [("2", "None", "", "0")] * 2)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    model = html_main.Model(rng.normal(size=3), rng.normal(size=(2, 2)))
    parent, depth, x = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 1, 2, 2, 2]), rng.normal(size=(6, 3))
    total = np.zeros((6, 2))
    for state in range(64):
        s = [(state >> k) & 1 for k in range(6)]
        p = math.exp(sum(s[k] * (x[k] @ model.weights) for k in range(6)) + sum(model.edge[s[parent[k]], s[k]] for k in range(1, 6)))
        for k in range(6):
            total[k, s[k]] += p
    assert np.allclose(model.marginals(parent, depth, x), total[:, 1] / total.sum(1))
