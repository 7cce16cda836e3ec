import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import lexical, manifest, sharding
from tests.llm.conftest import CLASHING, SCHEMA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """Rows (doc_id, text, source, lang) with clashing extra columns."""
    full = [(i, t, lang, s, None if t is None else len(t), 1, 2, "k", 3, "x", 4) for i, t, s, lang in rows]
    return spark.createDataFrame(full, f"{SCHEMA}, {CLASHING}").repartition(3)


def odd_rows(corpus):
    """The corpus over a hot source, a null one and others, in several languages, with repeated and null ids."""
    rows = [(i, t, ["hot", "hot", "hot", None, "b"][k % 5], [None, "en", "en", "de"][k % 4]) for k, (i, t) in enumerate(corpus)]
    return rows + [rows[12]] * 3 + [(rows[13][0], "other text", "b", "en"), (None, "no id", "hot", "en"), (None, None, None, None)]


# ---- sharding --------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_equal_gapless_and_hold_the_mixture(spark, corpus, monkeypatch, shards):
    rows = odd_rows(corpus)
    out = sharding.assign(table(spark, rows), shards).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows if i is not None)
    assert len(out) == len(rows)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(shards))
    for k, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(n))
    sources = Counter("-" if s is None else f"={s}" for _, _, s, _ in rows)
    for k in sizes:
        held = Counter(r["stratum"] for r in out if r["shard"] == k)
        assert all(abs(held[s] - n / shards) <= 2 for s, n in sources.items())


def test_shards_do_not_depend_on_buckets_partitions_or_other_columns(spark, corpus):
    rows = [r for r in odd_rows(corpus) if r[0] is not None]
    key = ["doc_id", "text_crc32"]
    want = sorted(map(tuple, sharding.interleave(table(spark, rows)).select(*key, "place").collect()))
    df = table(spark, rows).drop(*(c.split()[0] for c in CLASHING.split(", "))).repartition(7)
    assert sorted(map(tuple, sharding.interleave(df, bucket=5).select(*key, "place").collect())) == want
    assert [p for *_, p in sorted(want, key=lambda x: x[2])] == list(range(len(rows)))


def test_any_run_of_slots_holds_the_mixture(spark):
    rng = random.Random(3)
    rows = [(i, f"text {i}", rng.choice("aaaaabbc"), "en") for i in range(3_000)]
    out = sorted((r["place"], r["stratum"]) for r in sharding.interleave(table(spark, rows), bucket=100).collect())
    share = {s: n / len(out) for s, n in Counter(s for _, s in out).items()}
    for lo in range(0, 2_600, 130):
        held = Counter(s for _, s in out[lo : lo + 400])
        assert all(abs(held[s] - 400 * p) <= 3 for s, p in share.items())


def test_a_seed_shuffles_within_sources(spark):
    rows = table(spark, [(i, f"text {i}", "s", "en") for i in range(200)])
    a, b = (sorted(map(tuple, sharding.assign(rows, 2, seed=s).select("doc_id", "shard").collect())) for s in ("one", "two"))
    assert 60 < sum(x == y for x, y in zip(a, b)) < 140 and a != [(i, i // 100) for i in range(200)]


def test_no_rows_give_no_shards_and_written_shards_hold_all(spark, tmp_path):
    empty = table(spark, [(1, "a", "s", "en")]).limit(0)
    assert sharding.assign(empty).collect() == [] and manifest_rows(spark, empty) == []
    docs = table(spark, [(i, f"text {i}", "s", "en") for i in range(50)])
    sharding.write(docs, sharding.assign(docs, 4), f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(back.groupBy("shard").count().collect()) == [(0, 13), (1, 12), (2, 13), (3, 12)] and set(docs.columns) < set(back.columns)
    with pytest.raises(ValueError):
        sharding.write(docs.union(docs.limit(1)), sharding.assign(docs), f"{tmp_path}/twice")


# ---- ranked search ---------------------------------------------------------------------------


def plain_ranks(docs, items, k=20):
    """Scores as the contract states them, one by one."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    total, n_docs = sum(len(t) for _, t in terms), sum(1 for _, t in terms if t)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        asked, scored = TERM.findall((text or "").translate(LOWER)), []
        for i, t in terms:
            tf, m = Counter(t), 75 + 25 * len(t) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m)) for x in asked if tf[x])
            scored += [(-score, math.inf if i is None else i)] if score > 0 else []
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def asked_items(corpus):
    texts = [t for _, t in corpus if t]
    parts = [(k, " ".join(t.split()[3:20])) for k, t in enumerate(texts[5:25])]
    return parts + [(50, texts[12]), (51, None), (52, "!?"), (53, "never seen here"), (54, "abc ABC abc"), (55, "É ü, ünï-ONE1"), (54, "three abc")]


@pytest.mark.parametrize("terms, docs_of_a_tree, leaf", [(1_024, 8_192, 32), (12, 16, 1), (40, 7, 3)])
def test_ranks_equal_plain_scores(spark, corpus, frame, monkeypatch, terms, docs_of_a_tree, leaf):
    rows = corpus + [(5, "one three"), (None, corpus[20][1]), (70, corpus[20][1]), (70, corpus[20][1])]
    items = asked_items(corpus)
    for name, x in (("TERMS", terms), ("DOCS", docs_of_a_tree), ("LEAF", leaf)):
        monkeypatch.setattr(lexical, name, x)
    given = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    for k in (20, 2):
        assert sorted(map(tuple, lexical.rank(frame(rows), given, k).collect()), key=str) == plain_ranks(rows, items, k)


def test_items_in_blocks_give_the_same_ranks(spark, corpus, frame, monkeypatch):
    items = asked_items(corpus)[:12]
    given = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "ITEM_BYTES", 600)
    assert sorted(map(tuple, lexical.rank(frame(corpus), given).collect()), key=str) == plain_ranks(corpus, items)


def test_no_documents_or_items_give_no_ranks(spark, corpus, frame):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.rank(frame(corpus).limit(0), items).collect() == []
    assert lexical.rank(frame(corpus), items.limit(0)).collect() == []
    assert lexical.rank(frame([(1, None), (2, " .,")]), items).collect() == []


def test_bounds_hold_and_leave_documents_out():
    """No document scores above any node over it; most of a trie's documents aren't scored for an item that few hold."""
    rng = np.random.default_rng(2)
    counts = (rng.random((4_000, 60)) < np.linspace(0.6, 0.02, 60)) * rng.integers(1, 9, (4_000, 60))
    counts, m = counts[counts.any(axis=1)].astype(np.int32), rng.integers(75, 300, 4_000)
    tree = lexical.Tree(counts, m[: len(counts)], np.arange(len(counts)))
    columns, weights = np.array([1, 30, 45, 58, 59]), np.array([100, 900, 1500, 3000, 3100])
    scores = lexical.value(tree.counts[:, columns].astype(np.int64), tree.m[:, None]) @ weights
    bounds = lexical.value(tree.most[:, columns].astype(np.int64), tree.least[:, None]) @ weights
    assert all(scores[lo:hi].max() <= b for lo, hi, b in zip(tree.first, tree.last, bounds))
    for at, n in enumerate(tree.children):
        if n:  # children part their parent's documents
            edges = [tree.first[c] for c in range(tree.child[at], tree.child[at] + n)] + [tree.last[tree.child[at] + n - 1]]
            assert edges[0] == tree.first[at] and edges[-1] == tree.last[at] and edges == sorted(set(edges))
    got, ids = tree.search(columns, weights, np.zeros(0, np.int64), np.zeros(0, np.int64), 20)
    best = np.lexsort((tree.ids, -scores))[:20]
    assert got.tolist() == scores[best].tolist() and ids.tolist() == tree.ids[best].tolist()
    leaves = [b for b, n in zip(bounds, tree.children) if not n]
    assert sum(b >= got[-1] for b in leaves) < 0.9 * len(leaves)


def test_documents_with_equal_terms_share_a_path():
    counts = np.array([[1, 1, 0], [2, 0, 1], [5, 3, 0], [1, 1, 1]], np.int32)
    order, common = lexical.Tree._paths(counts)
    assert sorted(order.tolist()[:3]) == [0, 2, 3] and order.tolist()[3] == 1 and sorted(common.tolist()[1:3]) == [2, 3] and common[3] == 1


def test_terms_are_matches_of_the_pattern():
    texts = ["", "aB1_c-d", "é̈x \x7f\x80y", "日本 語", "x" * 300_000]
    buf = np.frombuffer("\n".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) + 1 for t in texts)])[:-1]
    off = np.append(off, len(buf))
    h, d = lexical.term_hashes(buf, off)
    assert np.bincount(d, minlength=5).tolist() == [len(TERM.findall(t)) for t in texts]
    a, b = (lexical.term_hashes(np.frombuffer(x, np.uint8), np.array([0, 3]))[0] for x in (b"AB1", b"ab1"))
    assert a.tolist() == b.tolist() != []


# ---- manifest --------------------------------------------------------------------------------


def H(*x):
    return sha256("".join(x).encode()).hexdigest()


def plain_leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(level):
    out = [level]
    while len(level) > 1:
        out.append(level := [H(*level[k : k + 2]) for k in range(0, len(level), 2)])
    return out


def plain_siblings(levels, k):
    found = []
    for level in levels[:-1]:
        other = k ^ 1
        found.append((level[other] if other < len(level) else None, k & 1))
        k //= 2
    return found


def plain_manifest(rows):
    """Every row's (doc_id, leaf, subroot, root, proof, folded root): from the whole trees."""
    made = [(i, t, s, lang, None if t is None else len(t)) for i, t, s, lang in rows]
    leaf = lambda r, more=0: plain_leaf(r[0], r[2], r[3], None if r[4] is None else r[4] + more, r[1])
    langs = sorted({r[3] for r in made}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in made if r[3] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    levels = {x: plain_levels([leaf(r) for r in trees[x]]) for x in langs}
    top = plain_levels([levels[x][-1][0] for x in langs]) if langs else []
    out = []
    for at, x in enumerate(langs):
        for k, r in enumerate(trees[x]):
            path = plain_siblings(levels[x], k) + plain_siblings(top, at)
            now = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for other, left in path:
                now = H(now) if other is None else H(other, now) if left else H(now, other)
            out.append((r[0], leaf(r), levels[x][-1][0], top[-1][0], H(*(o for o, _ in path if o)), now))
    return sorted(out, key=str)


def claims():
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in manifest.FIELDS]
    return {"claim": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, manifest.leaf_digest(more))}


def manifest_rows(spark, docs):
    leaves, nodes, trees = manifest.build(docs, also=claims())
    out = manifest.prove(leaves, nodes, trees).join(trees, "tree").select("key", "leaf", "subroot", "root", "proof", "folded_root")
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("step, askers", [(10, 1 << 14), (2, 3), (1, 1)])
def test_manifest_equals_whole_trees(spark, corpus, monkeypatch, step, askers):
    monkeypatch.setattr(manifest, "STEP", step)
    monkeypatch.setattr(manifest, "ASKERS", askers)
    rows = odd_rows(corpus)
    assert manifest_rows(spark, table(spark, rows)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 9, 16, 17])
def test_small_trees(spark, monkeypatch, n):
    monkeypatch.setattr(manifest, "STEP", 2)
    rows = [(i, f"text {i}", "s", "en") for i in range(n)]
    assert manifest_rows(spark, table(spark, rows)) == plain_manifest(rows)


def test_some_leaves_are_proved_from_fewer_fetched_nodes(spark, corpus, monkeypatch):
    """Any subset of the leaves has the same proofs, though partitions then fetch nodes of lower levels."""
    monkeypatch.setattr(manifest, "STEP", 3)
    rows = [(i, f"text {i}", "s", ["en", "de", None][i % 3]) for i in range(100)]
    leaves, nodes, trees = manifest.build(table(spark, rows), also=claims())
    want = {r[0]: r[4:] for r in plain_manifest(rows)}
    some = manifest.prove(leaves.filter("key % 5 = 0 OR key < 7"), nodes, trees).collect()
    assert {r["key"]: (r["proof"], r["folded_root"]) for r in some} == {i: x for i, x in want.items() if i % 5 == 0 or i < 7}


def test_the_octopus_asks_for_what_cannot_be_derived_and_no_more():
    for n in (1, 2, 5, 8, 13, 32):
        levels = plain_levels([H(str(k)) for k in range(n)])
        for asked in ([0], [n - 1], range(n), range(0, n, 3)):
            need = manifest.missing(asked, n)
            assert len(need) == len(set(need))
            nodes = {(0, p): levels[0][p] for p in asked} | {x: levels[x[0]][x[1]] for x in need}
            assert manifest.derived(dict(nodes), asked, n)[manifest.height(n), 0] == levels[-1][0]
            for left_out in need:  # each is needed
                few = {x: h for x, h in nodes.items() if x != left_out}
                try:
                    assert manifest.derived(few, asked, n)[manifest.height(n), 0] != levels[-1][0]
                except KeyError:
                    pass
        assert manifest.missing(range(n), n) == []
        assert manifest.height(n) == len(levels) - 1 and [manifest.width(n, k) for k in range(len(levels))] == [len(x) for x in levels]


def test_a_changed_value_changes_its_root_alone(spark):
    rows = [(i, f"text {i}", "s", ["en", "de"][i % 2]) for i in range(40)]
    before = {r["tree"]: (r["subroot"], r["root"]) for r in manifest.build(table(spark, rows))[2].collect()}
    after = {r["tree"]: (r["subroot"], r["root"]) for r in manifest.build(table(spark, [(3, "other", "s", "de") if r[0] == 3 else r for r in rows]))[2].collect()}
    assert before["=en"][0] == after["=en"][0] and before["=de"][0] != after["=de"][0] and before["=en"][1] != after["=en"][1]


def test_null_and_empty_values_have_different_digests(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", "-"), ("", "a"), ("1:a", "")], "x string, y string")
    assert df.select(manifest.leaf_digest([F.col("x"), F.col("y")])).distinct().count() == 5
