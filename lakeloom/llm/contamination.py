"""Benchmark decontamination by greedy string tiling.

Documents and benchmark passages are compared as sequences of word hashes. Windows of `least` words,
hashed by running Karp-Rabin, are the seeds: a document and a passage that share one are tiled. The longest
common run of words that are free on both sides is marked, again and again, until none of `least`
words is left; tiles may come in any order, so reordered passages are found. A document is
contaminated if the tiles cover enough of a passage.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit

LEAST = 5
COVERAGE = 0.5
#: Passages are sent to all tasks up to so many bytes, which are counted first; else seeds are joined.
BROADCAST_BYTES = 32 << 20
#: Equal seeds of two texts that are listed at once, about.
HITS = 1 << 20


def _joined(side: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs (diagonal, start, end), those that meet on a diagonal joined."""
    order = np.lexsort((start, side))
    side, start, end = side[order], start[order], end[order]
    new = np.ones(len(side), bool)
    new[1:] = (side[1:] != side[:-1]) | (start[1:] != end[:-1])
    first = np.flatnonzero(new)
    return np.stack([side[first], start[first], end[np.append(first[1:], len(end)) - 1]]) if len(first) else np.zeros((3, 0), np.int64)


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of hashes: (start in a, start in b, length), the longest first; ties by the earliest in a, then in b."""
    least = max(1, min(least, len(b)))
    ha, _ = textkit.windows(a, np.zeros(len(a), np.int64), least)
    hb, _ = textkit.windows(b, np.zeros(len(b), np.int64), least)
    if not len(ha) or not len(hb):
        return []
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha, "left"), np.searchsorted(hb[order], ha, "right")
    # hits in a row on one diagonal are one run; texts that repeat themselves have many hits, so they are listed in blocks
    total = np.cumsum(hi - lo)
    if not len(total) or not total[-1]:
        return []
    block = (total - 1) // HITS
    runs = [np.zeros((3, 0), np.int64)]
    for part in np.split(np.arange(len(ha)), np.flatnonzero(np.diff(block)) + 1):
        n = (hi - lo)[part]
        i = np.repeat(part, n)
        j = order[np.repeat(lo[part], n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
        runs.append(_joined(i - j, i, i + 1))
    side, x, end = _joined(*np.concatenate(runs, axis=1))
    size = end - x + least - 1
    y = x - side
    heap = list(zip((-size).tolist(), x.tolist(), y.tolist()))
    heapq.heapify(heap)
    free_a, free_b, out = np.ones(len(a), bool), np.ones(len(b), bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        free = free_a[x : x - n] & free_b[y : y - n]
        if free.all():
            out.append((x, y, -n))
            free_a[x : x - n] = free_b[y : y - n] = False
        else:
            s, e = textkit.runs(free, np.array([0, -n]))
            for p, q in zip(s.tolist(), e.tolist()):
                if q - p >= least:
                    heapq.heappush(heap, (p - q, x + p, y + p))
    return out


class Passages:
    """All passages of a benchmark as word hashes, and the sorted seeds of which passages have them."""

    def __init__(self, rows: list[tuple[int, str | None]], least: int):
        self.items, self.least = [], least
        seeds, owners = [], []
        for item, text in sorted(rows, key=lambda r: r[0]):
            h, d, _, _ = textkit.word_hashes(*textkit.flat(pa.array([text], pa.string())))
            if len(h):
                w, _ = textkit.windows(h, d, min(least, len(h)))
                seeds.append(w), owners.append(np.full(len(w), len(self.items)))
                self.items.append((item, h))
        self.seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owners = self.seeds[order], self.owners[order]
        self.widths = sorted({min(least, len(h)) for _, h in self.items})

    def shared(self, h: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
        """(document number, passage number) of those that share a seed."""
        found = []
        for k in self.widths:
            w, at = textkit.windows(h, d, k)
            lo, hi = np.searchsorted(self.seeds, w, "left"), np.searchsorted(self.seeds, w, "right")
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            own = self.owners[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append(np.unique(np.repeat(d[at[hit]], n) * (len(self.items) + 1) + own))
        got = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return [divmod(int(x), len(self.items) + 1) for x in got]


FIELDS = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_items", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("contaminated", pa.bool_())]
SCHEMA = "doc_id long, n_words long, n_items long, item_id long, coverage double, n_tiles long, contaminated boolean"


def _judged(ids: list, h: np.ndarray, d: np.ndarray, passages_of, least: int, coverage: float) -> pa.RecordBatch:
    """A row per document; passages_of(k) gives the passages (item, hashes) that document k is tiled with."""
    edge, rows = np.searchsorted(d, np.arange(len(ids) + 1)), []
    for k, name in enumerate(ids):
        own, best, count = h[edge[k] : edge[k + 1]], (0.0, None, 0), 0
        for item, b in passages_of(k):
            found = tiles(own, b, least)
            share = sum(n for _, _, n in found) / len(b)
            count += share >= coverage
            if share > best[0]:
                best = (share, item, len(found))
        rows.append((name, len(own), count, best[1], best[0], best[2], count > 0))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(FIELDS), FIELDS)], [n for n, _ in FIELDS])


def check(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_items, item_id, coverage, n_tiles, contaminated), one row per row of docs.

    A-Z is lower-cased; words are runs without ASCII white space. coverage: the largest share of a
    passage's words that tiles cover, by item_id (the smallest on ties; null if no seed is shared);
    n_items: passages covered to at least `coverage`. A passage of fewer than `least` words is found
    only whole; one without words never. Null and empty texts share nothing; rows with a null or repeated id
    are judged each by their own text; very long texts are tiled whole. Passages with a null id or text are left out.
    Up to `broadcast_bytes` of passages, each document is tiled where it is read; beyond, seeds are joined
    and only texts with a seed move. Both ways give the same rows. An empty table of documents gives no rows, an empty
    benchmark covers nothing; other columns, whatever their names, are not looked at.
    """
    store.small_batches(docs)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("passage")).filter("item_id is not null and passage is not null")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    if size <= broadcast_bytes:
        known = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.toLocalIterator()])

        @textkit.released
        def here(batches):
            passages = Passages(known.value, least)
            for batch, buf, off in textkit.parts(batches):
                h, d, _, _ = textkit.word_hashes(buf, off)
                mine: dict[int, list] = {}
                for k, p in passages.shared(h, d):
                    mine.setdefault(k, []).append(passages.items[p])
                yield _judged(batch.column(0).to_pylist(), h, d, lambda k: mine.get(k, []), least, coverage)

        return rows.mapInArrow(here, SCHEMA)

    return _by_seeds(rows, items, least, coverage)


def _seeds(df: DataFrame, key: str, text: str, least: int, widths: list[int] | None = None) -> DataFrame:
    """(key, seed): windows of words. widths: all of these; None: as wide as a passage allows, and (width) tells."""

    @textkit.released
    def run(batches):
        for batch, buf, off in textkit.parts(batches, text=text):
            h, d, _, _ = textkit.word_hashes(buf, off)
            n = np.bincount(d, minlength=len(batch))
            for k in widths or range(1, least + 1):
                w, at = textkit.windows(h, d, k)
                if widths is None:
                    own = np.minimum(n[d[at]], least) == k
                    w, at = w[own], at[own]
                pair = np.unique(np.stack([d[at], w.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pair[0])), pa.array(pair[1]), pa.array(np.full(pair.shape[1], k))], [key, "seed", "width"])

    return df.select(key, text).mapInArrow(run, f"{key} long, seed long, width long")


def _by_seeds(rows: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """check() for passages too large to be broadcast. Texts are named by a hash, so copies are tiled once, whatever their ids;
    a text and a passage that share a seed are one row, so no task gets all the passages of a text."""
    item_seeds = store.cut(_seeds(items, "item_id", "passage", least))
    widths = sorted(r[0] for r in item_seeds.select("width").distinct().collect())  # `least` at most
    named = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = named.groupBy("key").agg(F.first("text").alias("text"))
    if not widths:
        widths = [least]
    pairs = _seeds(texts, "key", "text", least, widths).join(item_seeds.drop("width"), "seed").select("key", "item_id").distinct()
    both = store.cut(pairs).join(items, "item_id").join(named.select("key", "text").dropDuplicates(["key"]), "key").select("key", "item_id", "passage", "text")

    @textkit.released
    def run(batches):
        for batch in batches:
            out = []
            for key, item, passage, text in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (textkit.word_hashes(*textkit.flat(pa.array([x], pa.string())))[0] for x in (text, passage))
                found = tiles(a, b, least)
                out.append((key, item, sum(n for _, _, n in found) / len(b), len(found)))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["key", "item_id", "share", "n_tiles"])

    tiled = both.mapInArrow(run, "key long, item_id long, share double, n_tiles long").filter("share > 0")
    best = F.max_by(F.struct("item_id", "share", "n_tiles"), F.struct("share", -F.col("item_id")))
    judged = tiled.groupBy("key").agg(F.count_if(F.col("share") >= coverage).alias("n"), best.alias("best"))
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    n = F.coalesce("n", F.lit(0)).cast("long")
    out = named.select("doc_id", "key", n_words.alias("n_words")).join(judged, "key", "left")
    share, count = F.coalesce("best.share", F.lit(0.0)), F.coalesce("best.n_tiles", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n.alias("n_items"), F.col("best.item_id").alias("item_id"), share.alias("coverage"), count.alias("n_tiles"), (n > 0).alias("contaminated"))
