"""Language-model scoring with Elias-Fano n-gram tries.

Texts become word numbers once. A word's number comes from the task that counts the word: frequent
words get small numbers. The trigrams w2 w1 w0 of all documents are then dealt by their middle word w1
to shards. A very frequent w1 is spread over several shards by w2; the counts of its bigrams w1 w0, which no
such shard sees whole, are summed beforehand and travel with the trigrams. Each shard builds its part of the trie
from the training trigrams, writes it to a file, maps the file into memory and scores its trigrams with it.

The trie's paths are w1, w0, w2 for the probability of w0 after w2 w1 (with bigrams as inner nodes),
and w1, w2 for the back-off weight of a context. Probabilities are smoothed by interpolated absolute
discounting down to an additive unigram model, quantised, and stored beside Elias-Fano levels.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elias_fano, store, textkit

#: Text bytes of a chunk, vocabulary bytes counted by one task, tokens scored by one shard, about.
CHUNK_BYTES, BUCKET_BYTES, SHARD_TOKENS = 4 << 20, 8 << 20, 450_000
#: Count from twice which a word is spread over shards, at least; and the number of such words, at most.
HOT, MOST_HOT = 150_000, 1 << 21
#: Tokens of several chunks that are dealt together, so that a shard gets few large cells.
BATCH_TOKENS = 1_000_000
DISCOUNT, ADD = 0.75, 0.1
BOS, END = 0, 1  # numbers of the marks; words follow
END_HASH = np.uint64(0x8000000000000001)
_CODES = 65_000  # steps that unigram probabilities are quantised to
COUNTED = "chunk long, bucket long, told binary, tokens long, kinds long"


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers below 2^40 as byte planes, compressed."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c.astype("<i8", copy=False).view(np.uint8).reshape(n, 8).T[:5]) for c in columns]
    return n.to_bytes(8, "little") + pa.compress(np.concatenate([p.ravel() for p in planes]).tobytes() or b"\0", codec="zstd", asbytes=True)


def _spread(cell: bytes, k: int) -> list[np.ndarray]:
    n = int.from_bytes(cell[:8], "little")
    raw = np.frombuffer(pa.decompress(cell[8:], max(1, n * 5 * k), codec="zstd", asbytes=True), np.uint8)[: n * 5 * k].reshape(k, 5, n)
    out = np.zeros((k, n, 8), np.uint8)
    out[:, :, :5] = raw.transpose(0, 2, 1)
    return [out[i].reshape(-1).view("<i8") for i in range(k)]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one at a time, so that one chunk's bytes are copied at once."""
    for i in range(len(batch)):
        yield {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _cells(*rows: tuple, schema: str) -> pa.RecordBatch:
    """A batch of rows with the names and types of a schema of longs and binaries."""
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.binary()) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], list(names))


def _hash(x: np.ndarray) -> np.ndarray:
    return (textkit.mix(x.astype(np.uint64) + np.uint64(77)) >> np.uint64(2)).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Flags of the entries that differ from the one before in some column; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def chunks(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, ids, held, sizes, words, keys, n): some MB of text each, every word a place in the chunk's own sorted vocabulary `keys`.

    n: how often training documents of the chunk have each. A chunk's number is its own, even if another has the
    same rows. ids: the numbers, 0 for null, then a byte each that is 0 for null.
    """
    schema = "chunk long, ids binary, held binary, sizes binary, words binary, keys binary, n binary"

    @textkit.released
    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for name, (batch, buf, off) in enumerate(textkit.parts(batches, limit=chunk_bytes), task):
            h, d, _, _ = textkit.word_hashes(buf, off)
            vocab, place = np.unique(np.append(np.where(h == END_HASH, h + np.uint64(1), h), END_HASH), return_inverse=True)
            size = np.bincount(d, minlength=len(batch)) + 1
            tokens = np.full(size.sum(), place[-1])
            tokens[np.arange(len(d)) + d] = place[:-1]
            ids, out = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            count = np.bincount(tokens[np.repeat(out == 0, size)], minlength=len(vocab))
            ids = ids.fill_null(0).to_numpy().astype("<i8").tobytes() + ids.is_valid().to_numpy(zero_copy_only=False).tobytes()
            yield _cells((name, ids, out.tobytes(), size.astype("<i8").tobytes(), _squeeze(tokens), vocab.tobytes(), _squeeze(count)), schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def count_keys(keyed: DataFrame, buckets: int) -> DataFrame:
    """(chunk, bucket, told, tokens, kinds) from (chunk, keys, n[, heads]): of each key in the bucket, in the chunk's order, its count and its number.

    The count is the sum of n over all chunks. Buckets are ranges of the keys, which are hashes. The rows of
    chunk -1 have each bucket's sum and number of counted keys; with heads, their told has these per head.
    """

    @textkit.released
    def deal(batches):
        for batch in batches:
            for row in _rows(batch):
                keys = np.frombuffer(row["keys"], np.uint64)
                columns = _spread(row["n"], 1) + (_spread(row["heads"], 1) if "heads" in row else [])
                edge = np.searchsorted((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1).astype(np.uint64))
                full = np.flatnonzero(np.diff(edge))
                rows = [(row["chunk"], b, keys[edge[b] : edge[b + 1]].tobytes(), _squeeze(*(c[edge[b] : edge[b + 1]] for c in columns))) for b in full.tolist()]
                yield _cells(*rows, schema="chunk long, bucket long, h binary, n binary")

    @textkit.released
    def count(table):
        b, width = table.column("bucket")[0].as_py(), 2 if headed else 1
        hs = [np.frombuffer(c.as_buffer(), np.uint64) for c in table.column("h")]
        h, first, back = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
        columns = [np.concatenate(x) for x in zip(*(_spread(c.as_py(), width) for c in table.column("n")))]
        n = np.bincount(back, weights=columns[0], minlength=len(h)).astype(np.int64)  # sums below 2^53 are exact
        number = np.empty(len(h), np.int64)
        number[np.lexsort((h, -n))] = np.arange(len(h)) * buckets + b + 2
        number[h == END_HASH] = END
        edge = np.cumsum([0, *map(len, hs)])
        rows = [(c, b, _squeeze(n[back[i:j]], number[back[i:j]]), 0, 0) for c, i, j in zip(table.column("chunk").to_pylist(), edge, edge[1:])]
        total = b""
        if headed:
            heads, at = np.unique(columns[1][first], return_inverse=True)
            sums = np.bincount(at, weights=n, minlength=len(heads)).astype(np.int64)
            total = _squeeze(heads, sums, np.bincount(at[n > 0], minlength=len(heads)))
        return pa.Table.from_batches([_cells(*rows, (-1, b, total, int(n.sum()), int((n > 0).sum())), schema=COUNTED)])

    headed = "heads" in keyed.columns
    return keyed.mapInArrow(deal, "chunk long, bucket long, h binary, n binary").groupBy("bucket").applyInArrow(count, COUNTED)


def told_by_chunk(counted: DataFrame, name: str) -> DataFrame:
    return counted.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "told")).alias(name))


def _told(parts: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(count, number) of each of a chunk's keys."""
    count, number = (np.concatenate(x) for x in zip(*(_spread(p["told"], 2) for p in sorted(parts, key=lambda p: p["bucket"]))))
    return count, number


class Scale:
    """Unigram probabilities of a training set of n_train tokens and n_kinds distinct ones, and their quantisation."""

    def __init__(self, n_train: int, n_kinds: int):
        self.floor = ADD * (n_kinds + 1) + n_train
        self.low, self.high = np.log10(ADD / self.floor), np.log10((n_train + ADD) / self.floor)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADD) / self.floor)

    def code(self, count: np.ndarray) -> np.ndarray:
        return np.rint((self.unigram(count) - self.low) / max(self.high - self.low, 1e-12) * _CODES).astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes / _CODES * (self.high - self.low)


def number_words(joined: DataFrame, scale: Scale) -> DataFrame:
    """(chunk, ids, held, sizes, words, told, facts): told has each place's count and number; facts are the base score and number of known tokens of every row."""

    @textkit.released
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                count, number = _told(row["parts"])
                sizes, (words,) = np.frombuffer(row["sizes"], "<i8"), _spread(row["words"], 1)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(doc, weights=scale.unigram(count)[words], minlength=len(sizes))
                known = np.bincount(doc, weights=count[words] > 0, minlength=len(sizes))
                facts = base.astype("<f8").tobytes() + known.astype("<i8").tobytes()
                yield _cells((row["chunk"], row["ids"], row["held"], row["sizes"], row["words"], _squeeze(count, number), facts), schema=schema)

    schema = "chunk long, ids binary, held binary, sizes binary, words binary, told binary, facts binary"
    return joined.mapInArrow(run, schema)


class Chunk:
    """A numbered chunk: w0, w1, w2 of every token, their row, unigram counts, and whether the row is held out."""

    def __init__(self, row: dict, spans):
        self.name, self.sizes = row["chunk"], np.frombuffer(row["sizes"], "<i8")
        (words,), (count, number) = _spread(row["words"], 1), _spread(row["told"], 2)
        self.held = np.repeat(np.frombuffer(row["held"], np.uint8), self.sizes)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.w0, self.count = number[words], count[words]
        first = np.cumsum(self.sizes) - self.sizes
        self.w1 = np.concatenate([[BOS], self.w0[:-1]])
        self.w1[first] = BOS
        self.w2 = np.concatenate([[BOS], self.w1[:-1]])
        self.w2[first] = BOS
        # shards that each token's w1 is spread over; BOS is as frequent as END, the last token of every chunk
        of = spans(count)
        self.many = np.concatenate([[1], of[words][:-1]])
        self.many[first] = of[words[-1]]
        self.hot = np.flatnonzero(self.many > 1)
        self.hot_keys, self.hot_place = np.unique(textkit.mix(self.w1[self.hot].astype(np.uint64) * textkit._P + self.w0[self.hot].astype(np.uint64)), return_inverse=True)


def hot_bigrams(numbered: DataFrame, spans) -> DataFrame:
    """(chunk, keys, n, heads) for count_keys: the bigrams of every chunk whose w1 is spread over shards, with w1 as the head."""

    @textkit.released
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                x = Chunk(row, spans)
                if len(x.hot):
                    n = np.bincount(x.hot_place[x.held[x.hot] == 0], minlength=len(x.hot_keys))
                    heads = np.empty(len(x.hot_keys), np.int64)
                    heads[x.hot_place] = x.w1[x.hot]
                    yield _cells((x.name, x.hot_keys.tobytes(), _squeeze(n), _squeeze(heads)), schema=schema)

    schema = "chunk long, keys binary, n binary, heads binary"
    return numbered.mapInArrow(run, schema)


def head_sums(counted: DataFrame) -> np.ndarray:
    """Rows (w1, count of its bigrams, kinds of them), by rising w1, of the words that are spread; at most MOST_HOT."""

    @textkit.released
    def run(batches):
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _spread(cell, 3)], ["w1", "total", "kinds"])

    heads = counted.filter("chunk = -1").select("told").mapInArrow(run, "w1 long, total long, kinds long")
    return heads.groupBy("w1").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).orderBy("w1").toPandas().to_numpy(np.int64).reshape(-1, 3)


def deal(numbered: DataFrame, shards: int, spans, scale: Scale, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(shard, chunks, cell): the trigrams of some chunks that go to a shard, sorted, with the row of each."""

    def slim(x: np.ndarray) -> np.ndarray:
        return x.astype(np.int32) if not len(x) or x.max() < 1 << 31 else x

    def tokens(row: dict, first: int, name: int) -> tuple[list[np.ndarray], int]:
        """(shard, w1, w0, w2, code, bigram's count, row * 2 + held out) of a chunk's tokens, and its number of rows."""
        x = Chunk(row, spans)
        bigram = np.zeros(len(x.w0), np.int64)
        if len(x.hot):
            bigram[x.hot] = _told(row["hot"])[0][x.hot_place]
        # a frequent mark of beginnings goes where its chunks go: its trigrams are its bigrams, whose counts they carry
        by = np.where(x.w1 == BOS, _hash(np.full(1, name))[0], _hash(x.w2))
        where = (_hash(x.w1) + np.where(x.many > 1, by % x.many, 0)) % shards
        return [slim(c) for c in (where, x.w1, x.w0, x.w2, scale.code(x.count), bigram, (x.doc + first) * 2 + x.held)], len(x.sizes)

    def send(names: list[tuple[int, int]], parts: list[list[np.ndarray]]):
        where, w1, w0, w2, code, bigram, owner = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order = np.lexsort((w2, w0, w1, where))
        edge = np.searchsorted(where[order], np.arange(shards + 1))
        told, rows = np.array(names, "<i8").tobytes(), []
        for s in np.flatnonzero(np.diff(edge)).tolist():
            k = order[edge[s] : edge[s + 1]]
            # sorted, so steps are small: of w1, of w0 under one w1, and of w2 under both; what both decide stands where they change
            x1, x0, x2 = w1[k].astype(np.int64), w0[k].astype(np.int64), w2[k].astype(np.int64)
            new1, new0 = _changes(x1), _changes(x1, x0)
            b, c = np.where(new1, x0, np.diff(x0, prepend=0)), np.where(new0, x2, np.diff(x2, prepend=0))
            rows.append((s, told, _squeeze(np.diff(x1, prepend=0), b, c, np.where(new0, code[k], 0), np.where(new0, bigram[k], 0), owner[k])))
        return _cells(*rows, schema="shard long, chunks binary, cell binary")

    @textkit.released
    def run(batches):
        names, parts, size, docs = [], [], 0, 0
        for batch in batches:
            for row in _rows(batch):
                names.append((row["chunk"], docs))
                part, n = tokens(row, docs, names[0][0])
                parts.append(part)
                size, docs = size + len(part[0]), docs + n
                if size >= batch_tokens:
                    yield send(names, parts)
                    names, parts, size, docs = [], [], 0, 0
        if names:
            yield send(names, parts)

    return numbered.mapInArrow(run, "shard long, chunks binary, cell binary")


def _running(step: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Values from steps that begin anew at the flagged entries."""
    total = np.cumsum(step)
    return total - (total - step)[np.maximum.accumulate(np.where(fresh, np.arange(len(step)), 0))]


class Cell:
    """A cell as dealt: the kinds of trigrams in it, and the kind and row of each."""

    def __init__(self, cell: bytes):
        a, b, c, code, bigram, owner = _spread(cell, 6)
        new1 = a != 0
        new1[:1] = True
        self.w1 = np.cumsum(a)
        self.w0 = _running(b, new1)
        new0 = new1 | (b != 0)
        self.w2 = _running(c, new0)
        new = new0 | (c != 0)
        first, self.kind = np.flatnonzero(new), np.cumsum(new) - 1
        top = np.maximum.accumulate(np.where(new0, np.arange(len(a)), 0))[first]
        self.kinds = np.stack([self.w1[first], self.w0[first], self.w2[first], code[top], bigram[top], np.bincount(self.kind[(owner & 1) == 0], minlength=len(first))])
        self.owner = owner >> 1


def build(kinds: np.ndarray, u: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    """A shard's trie. kinds: rows w1, w0, w2, _, count of the bigram if w1 is spread, count; a column per trigram, by rising (w1, w0, w2).

    u: log10 of w0's unigram probability; hot: from head_sums.
    """
    w1, w0, w2, _, carried, c3 = kinds
    at = np.minimum(np.searchsorted(hot[:, 0], w1), max(len(hot) - 1, 0)) if len(hot) else np.zeros(len(w1), np.int64)
    is_hot = hot[at, 0] == w1 if len(hot) else np.zeros(len(w1), bool)
    start = is_hot & (w1 == BOS)
    c3 = np.where(start, carried, c3)  # after the mark of beginnings, a trigram is its bigram
    first = np.flatnonzero(_changes(w1, w0))
    c2 = np.where(is_hot[first], carried[first], np.add.reduceat(c3, first) if len(first) else 0)
    seen = c2 > 0
    of_pair = np.cumsum(_changes(w1, w0)) - 1
    b1, b0, c2, bu, b_at, b_hot = w1[first][seen], w0[first][seen], c2[seen], u[first][seen], at[first][seen], is_hot[first][seen]
    heads, node, followers = np.unique(b1, return_inverse=True, return_counts=True)
    total = np.bincount(node, weights=c2, minlength=len(heads))
    if b_hot.any():  # sums over all shards instead of this one's
        total[node[b_hot]], followers[node[b_hot]] = hot[b_at[b_hot], 1], hot[b_at[b_hot], 2]
    weight1 = DISCOUNT * followers / total
    p2 = (c2 - DISCOUNT) / total[node] + weight1[node] * 10.0**bu
    three = np.flatnonzero(c3 > 0)
    parent = (np.cumsum(seen) - 1)[of_pair[three]]
    up = node[parent]
    ctx = np.lexsort((w2[three], up))
    new = _changes(up[ctx], w2[three][ctx])
    kind = np.empty(len(three), np.int64)
    kind[ctx] = np.cumsum(new) - 1
    head = ctx[new]
    total3, kinds3 = np.bincount(kind, weights=c3[three], minlength=len(head)), np.bincount(kind, minlength=len(head))
    mark = start[three][head]
    total3, kinds3 = np.where(mark, total[up[head]], total3), np.where(mark, followers[up[head]], kinds3)
    weight2 = DISCOUNT * kinds3 / total3
    p3 = (c3[three] - DISCOUNT) / total3[kind] + weight2[kind] * p2[parent]
    level = elias_fano.Level.encode
    parts = {"one": level(np.zeros(len(heads), np.int64), 1, heads, np.log10(weight1)), "two": level(node, len(heads), b0, np.log10(p2)), "three": level(parent, len(b0), w2[three], np.log10(p3)), "ctx": level(up[head], len(heads), w2[three][head], np.log10(weight2))}
    return {f"{a}.{b}": x for a, p in parts.items() for b, x in p.items()}


def query(trie: dict[str, np.ndarray], w0: np.ndarray, w1: np.ndarray, w2: np.ndarray, u: np.ndarray) -> np.ndarray:
    """log10 P(w0 | w2 w1) of each trigram, from a trie read in place; u: log10 of w0's unigram probability."""
    level = {a: elias_fano.Level({k[len(a) + 1 :]: v for k, v in trie.items() if k.startswith(a + ".")}) for a in ("one", "two", "three", "ctx")}
    head = level["one"].find(np.zeros(len(w1), np.int64), w1)
    two = level["two"].find(head, w0)
    three = level["three"].find(two, w2)
    ctx = level["ctx"].find(head, w2)
    lower = np.where(two >= 0, level["two"].log(two), level["one"].log(head) + u)
    return np.where(three >= 0, level["three"].log(three), level["ctx"].log(ctx) + lower)


def mapped(trie: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The trie in a file of its own, mapped into memory; the file has no name and goes with the arrays."""
    with tempfile.TemporaryFile() as f:
        f.write(elias_fano.pack(trie))
        f.flush()
        return elias_fano.unpack(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def shard_scores(scale: Scale, heads):
    """For applyInArrow over shards: (chunk, places, scores), what the shard's trigrams add to the scores of a chunk's rows. heads: broadcast head_sums."""

    @textkit.released
    def run(table: pa.Table) -> pa.Table:
        cells = table.column("cell")
        found = [Cell(c.as_py()).kinds for c in cells]
        edge = np.cumsum([0] + [k.shape[1] for k in found])
        kinds = np.concatenate(found, axis=1)
        del found
        order = np.lexsort(kinds[2::-1])
        new = _changes(*kinds[:3, order])
        kind_of = np.empty(len(order), np.int32)
        kind_of[order] = np.cumsum(new) - 1
        count = np.bincount(kind_of, weights=kinds[5], minlength=int(new.sum())).astype(np.int64)
        kinds = kinds[:, order[new]]
        kinds[5] = count
        u = scale.decode(kinds[3])
        trie = mapped(build(kinds, u, heads.value))
        logs = np.empty(kinds.shape[1])
        for i in range(0, len(logs), 1 << 17):
            part = slice(i, i + (1 << 17))
            logs[part] = query(trie, kinds[1, part], kinds[0, part], kinds[2, part], u[part])
        rows = []
        for cell, names, i in zip(cells, table.column("chunks"), edge):
            x = Cell(cell.as_py())
            names = np.frombuffer(names.as_py(), "<i8").reshape(-1, 2)
            total = np.bincount(x.owner, weights=logs[kind_of[i + x.kind]])
            own = np.flatnonzero(np.bincount(x.owner))
            parts = np.searchsorted(own, np.append(names[:, 1], len(total)))
            for (name, first), lo, hi in zip(names.tolist(), parts, parts[1:]):
                if lo < hi:
                    rows.append((name, _squeeze(np.diff(own[lo:hi] - first, prepend=0)), total[own[lo:hi]].astype("<f4").tobytes()))
        return pa.Table.from_batches([_cells(*rows, schema="chunk long, places binary, scores binary")])

    return run


@textkit.released
def gather(table: pa.Table) -> pa.Table:
    """Rows of one chunk from its facts and what shards add to its scores."""
    score = None
    for row in table.filter(table.column("ids").is_valid()).to_pylist():
        sizes, held, n = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["held"], bool), len(row["held"])
        ids, named = np.frombuffer(row["ids"], "<i8", n), np.frombuffer(row["ids"], bool, n, 8 * n)
        base, known = np.frombuffer(row["facts"], "<f8", n), np.frombuffer(row["facts"], "<i8", n, 8 * n)
        score = np.zeros(n)
    for places, scores in zip(table.column("places"), table.column("scores")):
        if places.is_valid:
            (step,) = _spread(places.as_py(), 1)
            score[np.cumsum(step)] += np.frombuffer(scores.as_buffer(), "<f4")
    return pa.table({"doc_id": pa.array(ids, mask=~named), "held_out": held, "n_tokens": sizes, "n_known": known, "base_score": base, "score": score})


def score(docs: DataFrame, held: Column, bucket_bytes: int = BUCKET_BYTES, shard_tokens: int = SHARD_TOKENS, hot_count: int = HOT, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    The model learns from the rows where `held` is false. Tokens are words of the text with A-Z
    lower-cased, then one end. A null or empty text has the end alone; a very long one is a chunk of its own.
    Rows that repeat an id or have none are scored each, and come back with that id or null. Other columns
    don't matter. With no training rows every token has probability 1, as N and V are 0. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    chunked = store.cut(chunks(rows, F.col("held")))
    size = chunked.agg(F.sum(F.length("keys"))).first()[0] or 0
    counted = store.cut(count_keys(chunked.select("chunk", "keys", "n"), max(1, size // bucket_bytes)))
    n_train, n_kinds = (x or 0 for x in counted.agg(F.sum("tokens"), F.sum("kinds")).first())
    scale, shards, hot_count = Scale(n_train, n_kinds), max(1, n_train // shard_tokens), max(hot_count, n_train // MOST_HOT)
    spans = lambda count: np.minimum(np.maximum(count // hot_count, 1), shards)
    numbered = store.cut(number_words(chunked.drop("keys", "n").join(told_by_chunk(counted, "parts"), "chunk"), scale))
    store.discard(chunked, counted)

    heads, dealt = np.zeros((0, 3), np.int64), numbered.select("chunk", "held", "sizes", "words", "told")
    if shards > 1 and n_train >= 2 * hot_count:
        keyed = hot_bigrams(dealt, spans)
        hot = store.cut(count_keys(keyed, max(1, size // bucket_bytes)))
        heads, dealt = head_sums(hot), dealt.join(told_by_chunk(hot, "hot"), "chunk", "left")
    known = docs.sparkSession.sparkContext.broadcast(heads)
    added = deal(dealt, shards, spans, scale, batch_tokens).groupBy("shard").applyInArrow(shard_scores(scale, known), "chunk long, places binary, scores binary")
    parts = numbered.select("chunk", "ids", "held", "sizes", "facts").unionByName(added, allowMissingColumns=True)
    out = parts.groupBy("chunk").applyInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(n_train).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
