"""Ranked lexical search: document FP-trees and depth-first branch-and-bound.

A document is its vector of the terms that some item asks for, in the order of falling document frequency. Vectors that
begin alike share a path of a trie, as in an FP-tree; a node of it stands for all documents below. Of every node the
largest count of each term (0 where no document below has it) and the smallest length norm m are known, and as a score
grows with counts and falls with m, these bound what any document below can reach. Items go depth first through the
trie, the most promising child first, and leave out what can't reach their k-th best score.

Texts are read once per block of items; a task keeps its best k of an item from one tree to the next, so that later
trees are cut from the start.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textkit

#: Results of an item.
K = 20
#: Bytes of item texts that are searched for together; their terms go to all tasks.
ITEM_BYTES = 8 << 20
#: Terms of the items that one trie is made for, unless a single item has more.
TERMS = 1_024
#: Cells (documents x terms) of a trie's table of counts, and documents in it, at most.
CELLS, DOCS = 8 << 20, 8_192
#: A subtree of at most so many documents isn't parted further.
LEAF = 32
#: Groups that an item's candidates are ranked in before they meet.
SALTS = 64
SCALE = 1_000_000_000
NO_ID = np.iinfo(np.int64).max
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, document numbers) of all terms: runs of ASCII letters and digits and of all other characters above ASCII."""
    s, e = textkit.runs(IS_TERM[buf], off)
    return textkit.hash_spans(textkit.prefix_hash(textkit.LOWER[buf]), s, e), np.searchsorted(off, s, "right") - 1


#: An item's number, its terms (numbers in the block's vocabulary) and each term's weight times its occurrences in the item.
Query = tuple[int, np.ndarray, np.ndarray]


def value(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence of a term in an item earns, but for the term's weight; tf and m are 64-bit integers."""
    return SCALE * tf // (1000 * tf + 12 * m)


class Tree:
    """A trie over documents: counts (documents x terms, terms by falling document frequency), norms m and ids."""

    def __init__(self, counts: np.ndarray, m: np.ndarray, ids: np.ndarray):
        order, common = self._paths(counts)
        self.counts, self.m, self.ids = counts[order], m[order], ids[order]
        first, last, child, children = [0], [len(m)], [0], [0]
        at = 0
        while at < len(first):
            lo, hi = first[at], last[at]
            inner = common[lo + 1 : hi]
            if hi - lo > LEAF and inner.min() < counts.shape[1]:
                starts = self._parted([lo, *(np.flatnonzero(inner == inner.min()) + lo + 1).tolist(), hi])
                child[at], children[at] = len(first), len(starts) - 1
                first += starts[:-1]
                last += starts[1:]
                child += [0] * (len(starts) - 1)
                children += [0] * (len(starts) - 1)
            at += 1
        self.first, self.last, self.child, self.children = first, last, child, children
        self.most = np.zeros((len(first), counts.shape[1]), np.int32)
        self.least = np.zeros(len(first), np.int64)
        for at in range(len(first) - 1, -1, -1):  # children stand after their parents
            below = slice(child[at], child[at] + children[at]) if children[at] else slice(first[at], last[at])
            of, m_of = (self.most, self.least) if children[at] else (self.counts, self.m)
            self.most[at], self.least[at] = of[below].max(axis=0), m_of[below].min()

    @staticmethod
    def _parted(edges: list[int]) -> list[int]:
        """The edges of a node's children, where small ones that stand side by side are one child of at most LEAF documents."""
        kept = edges[:1]
        for a, b in zip(edges, edges[1:]):
            if kept[-1] < a and b - kept[-1] > LEAF:
                kept.append(a)
        return [*kept, edges[-1]]

    @staticmethod
    def _paths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents in the order of their paths, and how many terms each shares with the one before; all, if it is alike."""
        doc, term = np.nonzero(counts)
        n = np.bincount(doc, minlength=len(counts))
        start = np.cumsum(n) - n
        wide = ">u2" if counts.shape[1] < 1 << 16 else ">u4"
        path = np.zeros((len(counts), max(int(n.max(initial=0)), 1)), wide)
        path[doc, np.arange(len(doc)) - start[doc]] = term + 1
        order = np.argsort(path.view(f"S{path.itemsize * path.shape[1]}").ravel(), kind="stable")
        path = path[order]
        common = np.full(len(counts), counts.shape[1], np.int64)
        differ = path[1:] != path[:-1]
        apart = differ.any(axis=1)
        common[1:][apart] = differ.argmax(axis=1)[apart]
        return order, common

    def search(self, columns: np.ndarray, weights: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of (scores, ids), what was found before, and the trie's documents; equal scores by rising id."""
        stack = [(NO_ID, 0)]
        while stack:
            bound, at = stack.pop()
            if bound < (floor := scores[-1] if len(scores) == k else 1):
                continue
            below = slice(self.child[at], self.child[at] + self.children[at]) if self.children[at] else slice(self.first[at], self.last[at])
            tf, m = (self.most, self.least) if self.children[at] else (self.counts, self.m)
            got = value(tf[below].take(columns, axis=1).astype(np.int64), m[below, None]) @ weights
            good = np.flatnonzero(got >= floor)
            if self.children[at]:
                good = good[np.argsort(got[good], kind="stable")]
                stack += zip(got[good].tolist(), (good + self.child[at]).tolist())
            elif len(good):
                scores, ids = np.append(scores, got[good]), np.append(ids, self.ids[below][good])
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
        return scores, ids


def batches_of(queries: list[Query]) -> Iterator[tuple[list[Query], np.ndarray]]:
    """The queries in batches of at most TERMS different terms, or one by one where one has more; with these terms."""
    held: list[Query] = []
    terms = np.zeros(0, np.int64)
    for q in queries:
        more = np.union1d(terms, q[1])
        if held and len(more) > TERMS:
            yield held, terms
            held, more = [], q[1]
        held, terms = [*held, q], more
    if held:
        yield held, terms


def _vectors(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, n, terms, counts): a document's number of terms and those of the vocabulary with their counts."""
        known = vocabulary.value
        for piece, buf, off in textkit.parts(batches):
            h, d = term_hashes(buf, off)
            n = np.bincount(d, minlength=len(piece))
            at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[at] == h if len(known) else np.zeros(len(h), bool)
            key, count = np.unique(d[hit] * max(len(known), 1) + at[hit], return_counts=True)
            doc = key // max(len(known), 1)
            each = np.bincount(doc, minlength=len(piece))
            terms = textkit.to_binary((key % max(len(known), 1)).astype("<i4"), each)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), terms, textkit.to_binary(count.astype("<i4"), each)], ["doc_id", "n", "terms", "counts"])

    return textkit.released(run)


def _frequencies(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=size)
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(found[own], pa.int64())], ["term", "df"])

    return textkit.released(run)


def _chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Documents (ids, m, number of terms, terms, counts), at most `most` at a time."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, len(batch), most):
            part = batch.slice(lo, most)
            if n + len(part) > most:
                yield _flat(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield _flat(held)


def _flat(held: list[pa.RecordBatch]) -> tuple:
    table = pa.Table.from_batches(held)
    terms, counts = (table[c].to_pylist() for c in ("terms", "counts"))
    each = np.fromiter((len(x) // 4 for x in terms), np.int64, len(terms))
    ids = table["doc_id"].fill_null(NO_ID).to_numpy()
    return ids, table["m"].to_numpy(), np.repeat(np.arange(len(terms)), each), np.frombuffer(b"".join(terms), "<i4"), np.frombuffer(b"".join(counts), "<i4")


def _search(asked, frequency, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(item, doc_id, score): the task's best k documents of every item."""
        plans, df = [], frequency.value
        for queries, terms in batches_of(asked.value):
            terms = terms[np.argsort(-df[terms], kind="stable")]
            column = np.full(len(df), -1, np.int32)
            column[terms] = np.arange(len(terms))
            plans.append((queries, column, len(terms)))
        most = min([DOCS, *(max(LEAF, CELLS // width) for _, _, width in plans)])
        found = {number: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for queries, _, _ in plans for number, _, _ in queries}
        for ids, m, doc, term, count in _chunks(batches, most):
            for queries, column, width in plans:
                counts = np.zeros((len(ids), width), np.int32)
                own = column[term] >= 0
                counts[doc[own], column[term[own]]] = count[own]
                some = counts.any(axis=1)
                if not some.any():
                    continue
                tree = Tree(counts[some], m[some], ids[some])
                for number, terms, weights in queries:
                    found[number] = tree.search(column[terms], weights, *found[number], k)
        items = np.repeat(np.fromiter(found, np.int64, len(found)), np.array([len(s) for s, _ in found.values()], np.int64))
        scores, ids = (np.concatenate([x[j] for x in found.values()] or [np.zeros(0, np.int64)]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], ["item", "doc_id", "score"])

    return textkit.released(run)


def _block(items: DataFrame) -> tuple[list, list[np.ndarray], np.ndarray]:
    """Ids and term hashes of a block's items, and their vocabulary; a block is bounded by ITEM_BYTES."""
    table = items.select("item_id", "text").toArrow().combine_chunks()
    ids, found = table["item_id"].to_pylist(), []
    for batch in table.to_batches():
        h, d = term_hashes(*textkit.flat(batch.column(1)))
        found += [h[d == i] for i in range(len(batch))]
    return ids, found, np.unique(np.concatenate([*found, np.zeros(0, textkit.U)]))


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): every item's k documents with the highest scores above 0.

    Terms, weights and scores are integers as the module's `value` and the README define them. Items are searched for in
    blocks of about ITEM_BYTES of text, every block over all documents.

    Defined results: null texts have no terms; equal scores stand in the order of doc_id, null ids last; rows of one
    doc_id are ranked each, and so are items that repeat an id; an item without a term that some document holds, or an
    empty table, gives no rows; texts count whole; other columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 40)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    out = [_rank_block(docs, items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), k) for b in range(blocks)]
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    if not out:
        return spark.createDataFrame([], schema)
    first, *rest = out
    for other in rest:
        first = first.unionByName(other)
    return first


def _rank_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    item_ids, hashes, vocabulary = _block(items)
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    vectors = store.cut(given.mapInArrow(_vectors(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms binary, counts binary"))
    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    some = vectors.filter(F.octet_length("terms") > 0)
    df = np.zeros(len(vocabulary), np.int64)
    found = some.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for batch in found.toArrow().to_batches():  # at most a row per term of the block
        df[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    queries = []
    for number, h in enumerate(hashes):
        terms, times = np.unique(np.searchsorted(vocabulary, h), return_counts=True)
        terms, times = terms[df[terms] > 0], times[df[terms] > 0]
        if len(terms):
            queries.append((number, terms, weight[terms] * times))
    some = some.withColumn("m", F.expr(f"75 + 25 * n * {n_docs}L div {max(n_terms or 0, 1)}L")).select("doc_id", "m", "terms", "counts")
    best = some.mapInArrow(_search(spark.sparkContext.broadcast(queries), spark.sparkContext.broadcast(df), k), "item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(item_ids)), f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH t AS (SELECT doc_id, {_TERMS} AS terms FROM documents), d AS (SELECT doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
  s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d), f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM t) GROUP BY ALL),
  q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
  w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s WHERE term IN (SELECT term FROM q) GROUP BY 1),
  scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 20"""
