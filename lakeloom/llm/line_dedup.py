"""Near-duplicate lines by an exact set-similarity join.

A line's set are its distinct words, ordered by rarity. If two sets are similar enough, they share a
word within their prefixes, so only prefixes are dealt, by word; sets so small that only equal ones are
similar deal none. Within a word's lines, pairs must pass
the length filter, the positional filter and a filter on marks of the sets, 64, 128 or 256 bits by their
size: every word turns one bit over, so marks differ in at most as many bits as sets in words. What is left is
verified on the full sets. A line goes if an earlier line is similar: any earlier one of the input, by
(doc_id, line number).

Rarity is the count in a table of fixed size that words are hashed to. Any order that is the same
for all lines gives exact results, so the table's collisions cost only time, and its size is a bound
on what is broadcast. Equal sets are joined first and count as their earliest line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit
from .language_model import _spread, _squeeze
from .minhash import hot_pivots, overlap

PERCENT = 80
#: By default, lines with fewer distinct words always stay. The registered query and the pipeline ask for EVERY: each line with a word.
MIN_WORDS, EVERY = 4, 1
#: Slots of the rarity table (4 bytes each are broadcast), and the parts it is summed in.
SLOTS, RANGES = 1 << 20, 64
#: Earlier lines by word that a line is verified with in the first and second round; those then open get all.
FIRST_ROUND, SECOND_ROUND = 4, 256
#: Sets of more words have marks of 128 bits, and of 256 bits.
FEW, MANY = 64, 128
BUCKET_BYTES = 8 << 20
#: Bytes of text whose prefixes are dealt together: with one part's alone, cells grow in number with the square of the input.
DEAL_BYTES = 8 << 20
_NAME = np.uint64((1 << 40) - 1)


def rarity(docs: DataFrame) -> np.ndarray:
    """Counts of the words by slot, capped at 2^20 - 1."""

    @textkit.released
    def tally(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch, buf, off in textkit.parts(batches):
            h = textkit.word_hashes(buf, off)[0]
            total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
        cells = [pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in total.reshape(RANGES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES)), pa.array(cells, pa.binary())], ["part", "cell"])

    def add(table):
        width = SLOTS // RANGES
        total = sum(np.frombuffer(pa.decompress(c.as_py(), width * 8, codec="zstd", asbytes=True), np.int64) for c in table.column("cell"))
        return pa.table({"part": table.column("part")[:1], "cell": pa.array([np.minimum(total, (1 << 20) - 1).astype(np.uint32).tobytes()], pa.binary())})

    rows = docs.select("doc_id", "text").mapInArrow(tally, "part long, cell binary").groupBy("part").applyInArrow(add, "part long, cell binary").collect()  # 64 rows of fixed size
    out = np.zeros(SLOTS, np.uint32).reshape(RANGES, -1)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["cell"], np.uint32)
    return out.ravel()


def line_sets(buf: np.ndarray, off: np.ndarray, count: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Of every line with at least `least` distinct words: document, line number, set hash, set size, first word, marks.

    `words` has all sets' words, rarest first; a line's begin at `first`.
    """
    h, d, s, _ = textkit.word_hashes(buf, off)
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, s) + d  # rises with every line end and every document
    number = np.searchsorted(breaks, s) - np.searchsorted(breaks, off[:-1])[d]
    line = np.cumsum(np.diff(line, prepend=line[:1]) != 0)
    freq = count[(h >> np.uint64(44)).astype(np.int64)]
    key = (line.astype(np.uint64) << np.uint64(44)) | (freq.astype(np.uint64) << np.uint64(24)) | (h >> np.uint64(40))
    order = np.argsort(key, kind="stable")
    k, g = key[order], h[order]
    if ((k[1:] == k[:-1]) & (g[1:] != g[:-1])).any() or len(k) and line[-1] >= 1 << 20:
        order = np.lexsort((h, freq, line))
        g = h[order]
    li = line[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (li[1:] != li[:-1])
    order, g, li = order[new], g[new], li[new]
    first = np.flatnonzero(np.diff(li, prepend=-1))
    n = np.diff(np.append(first, len(g)))
    names = ["doc", "number", "set", "n", "first", "marks"]
    if not len(first):
        return {k: np.zeros(0, np.int64) for k in names} | {"set": np.zeros(0, np.uint64), "marks": np.zeros((0, 4), np.uint64), "words": g}
    bit = textkit.mix(g) >> np.uint64(56)
    one = np.uint64(1) << (bit & np.uint64(63))
    marks = np.stack([np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == np.uint64(k), one, np.uint64(0)), first) for k in range(4)], axis=1)
    sets = np.add.reduceat(textkit.mix(g + np.uint64(5)), first) + n.astype(np.uint64)
    keep = n >= least
    got = d[order[first]], number[order[first]], sets, n, first, marks
    return {k: x[keep] for k, x in zip(names, got)} | {"words": g}


def _prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _prefix(x: dict[str, np.ndarray], k: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, word hash) of every word in the prefixes of the lines k."""
    size = _prefix_size(x["n"][k], percent)
    who = np.repeat(k, size)
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return who, pos, x["words"][x["first"][who] + pos]


def _name(word: np.ndarray) -> np.ndarray:
    return word >> np.uint64(20) & _NAME


def _packed(ids: np.ndarray) -> bytes:
    """Ids as the steps between them, byte plane by byte plane, compressed: each of very many cells names its documents."""
    steps = np.diff(ids, prepend=np.int64(0)).astype("<i8")
    return len(ids).to_bytes(8, "little") + pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() or b"\0", codec="zstd", asbytes=True)


def _unpacked(cell: bytes) -> np.ndarray:
    n = int.from_bytes(cell[:8], "little")
    planes = np.frombuffer(pa.decompress(cell[8:], max(1, 8 * n), codec="zstd", asbytes=True), np.uint8)[: 8 * n].reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel())


def _width(n: np.ndarray) -> np.ndarray:
    """Words of 64 bits in the marks of sets of n words."""
    return 1 + (n > FEW) + 2 * (n > MANY)


def _marked(marks: np.ndarray, n: np.ndarray) -> bytes:
    """Marks of 256 bits, folded to what sets of n words have."""
    out, some, few = marks.copy(), n <= MANY, n <= FEW
    out[some, :2] ^= out[some, 2:]
    out[few, 0] ^= out[few, 1]
    return out[np.arange(4) < _width(n)[:, None]].tobytes()


def _marks(cell: bytes, n: np.ndarray) -> np.ndarray:
    """The marks that `_marked` packed, with 0 for what is not there: folding them further gives those of smaller sets."""
    out = np.zeros((len(n), 4), np.uint64)
    out[np.arange(4) < _width(n)[:, None]] = np.frombuffer(cell, np.uint64)
    return out


def prefixes(docs: DataFrame, count: np.ndarray, percent: int, least: int, buckets: int, only: np.ndarray | None = None) -> DataFrame:
    """(bucket, ids, cell, marks): lines' prefixes by the bucket of their words; where marks is null,
    cell has all lines of some documents (document, number, set). only: sorted names of the words that are asked about; lines are not told then."""
    known = docs.sparkSession.sparkContext.broadcast((count, only))
    small = np.uint16 if buckets < 1 << 16 else np.int64
    low = np.uint64((1 << 32) - 1)
    schema = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("cell", pa.binary()), ("marks", pa.binary())])

    def ask(x, ids):
        """Of a part's lines, one for each set, and the words of their prefixes."""
        k = _earliest(x["set"], ids[x["doc"]], x["number"])
        k = np.sort(k[100 * x["n"][k] >= percent * (x["n"][k] + 1)])  # smaller sets are similar to equal ones only, which need no prefix
        _, pos, word = _prefix(x, k, percent)
        return {"id": ids[x["doc"][k]]} | {c: x[c][k] for c in ("number", "set", "n", "marks")}, pos, word

    def deal(held, only):
        line = {c: np.concatenate([x[0][c] for x in held]) for c in held[0][0]}
        pos, word = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        first = np.zeros(len(line["n"]), bool)
        first[_earliest(line["set"], line["id"], line["number"])] = True
        who = np.repeat(np.arange(len(first)), _prefix_size(line["n"], percent))
        take = first[who] if only is None else first[who] & np.isin(_name(word), only)
        who, pos, word = who[take], pos[take], word[take]
        where = (word % np.uint64(buckets)).astype(small)
        order = np.argsort(where, kind="stable")
        own, edge = np.unique(where[order], return_index=True)
        for b, lo, hi in zip(own.tolist(), edge, np.append(edge[1:], len(order))):
            i = order[lo:hi]
            w = who[i]
            here, doc = np.unique(line["id"][w], return_inverse=True)
            yield b, _packed(here), _squeeze(doc, line["number"][w], line["set"][w] >> np.uint64(32), line["set"][w] & low, _name(word[i]), pos[i], line["n"][w]), _marked(line["marks"][w], line["n"][w])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, schema.types)], schema.names)

    @textkit.released
    def run(batches):
        count, only = known.value
        held, bytes_held = [], 0
        for batch, buf, off in textkit.parts(batches):
            x = line_sets(buf, off, count, least)
            ids = batch.column(0).to_numpy().astype("<i8")
            if only is None:
                yield batch_of([(int(len(buf) + off[len(off) // 2]) % buckets, _packed(ids), _squeeze(x["doc"], x["number"], x["set"] >> np.uint64(32), x["set"] & low), None)])
            held.append(ask(x, ids))
            bytes_held += len(buf)
            if bytes_held >= DEAL_BYTES:
                yield batch_of(list(deal(held, only)))
                held, bytes_held = [], 0
        if held:
            yield batch_of(list(deal(held, only)))

    return docs.select("doc_id", "text").mapInArrow(run, "bucket long, ids binary, cell binary, marks binary")


def _earliest(sets: np.ndarray, ids: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Places of the earliest line of every set."""
    order = np.lexsort((number, ids, sets))
    return order[np.flatnonzero(np.diff(sets[order], prepend=sets[order[:1]] ^ np.uint64(1)))] if len(order) else order


def prefix_names(docs: DataFrame, wanted: DataFrame, count: np.ndarray, percent: int, least: int) -> DataFrame:
    """(name): names of the words in the prefixes of the wanted lines (doc_id, pos)."""
    known = docs.sparkSession.sparkContext.broadcast(count)

    @textkit.released
    def run(batches):
        for batch, buf, off in textkit.parts(batches):
            x = line_sets(buf, off, known.value, least)
            _, _, word = _prefix(x, _picked(x, batch.column(2).to_pylist()), percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_name(word)).astype(np.int64))], ["name"])

    return _asked(docs, wanted).mapInArrow(run, "name long").distinct()


def _asked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, ask): documents with the numbers of their wanted lines (doc_id, pos)."""
    lists = store.cut(wanted.groupBy("doc_id").agg(F.collect_set("pos").alias("ask")))
    return docs.join(store.side(lists), "doc_id").select("doc_id", "text", "ask")


def _picked(x: dict[str, np.ndarray], ask: list[list[int]]) -> np.ndarray:
    """Places of the lines that are asked about, document by document."""
    want = {(k, p) for k, ps in enumerate(ask) for p in ps}
    return np.flatnonzero([pair in want for pair in zip(x["doc"].tolist(), x["number"].tolist())])


def _sets(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return ((high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)).view(np.int64)


PAIR = ["a", "b", "na", "nb", "a_doc", "a_pos", "b_doc", "b_pos", "turn", "more"]
ARROW = pa.schema([(c, pa.bool_() if c == "more" else pa.int64()) for c in PAIR])


#: Pairs that are looked at together, and lines of a word that are looked at first.
PAIRS, WINDOW = 1 << 17, 512
#: Lines that are paired together, and pairs that leave a task together: in a family of near lines each has SECOND_ROUND pairs a word.
TOGETHER, LEAVING = 1 << 11, 1 << 17


def places(word: np.ndarray, n: np.ndarray, pos: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A number for every entry that rises over all of them: its class (word, set size, place in the set) and its rank."""
    new = (np.diff(word, prepend=-1) != 0) | (np.diff(n, prepend=-1) != 0) | (np.diff(pos, prepend=-1) != 0)
    return (np.cumsum(new) - 1) * (len(word) + 1) + rank


def partners(word: np.ndarray, n: np.ndarray, pos: np.ndarray, rank: np.ndarray, place: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, lo, hi), rising by a: partners of entry a stand at lo .. hi, from the earliest; of its word's lines those that
    are earlier and pass the length and the positional filter.

    Entries are sorted by word, set size n, place pos of the word in the set, and rank, which rises with lateness. Lines of
    one word, size and place form a class, and both filters depend on the classes alone, so they cost nothing for
    each pair of lines: a template that puts its words too far behind its lines' own ones is left out as a whole.
    """
    if not len(word):
        return
    wide = len(word) + 1
    kind = place // wide
    start = np.flatnonzero(np.diff(kind, prepend=-1))
    of, cn, cp = np.cumsum(np.diff(word[start], prepend=word[:1]) != 0), n[start], pos[start]
    sizes = int(cn.max()) + 2
    key = of * sizes + cn
    first = np.searchsorted(key, of * sizes + -(-percent * cn // 100), "left")
    last = np.searchsorted(key, of * sizes + np.minimum(100 * cn // percent, sizes - 1), "right")
    edges = np.append(start, len(word))
    for lo, hi in _chunks(last - first):
        x = lo + np.repeat(np.arange(hi - lo), (last - first)[lo:hi])
        y = np.arange(len(x)) - np.searchsorted(x, x, "left") + first[x]
        need = -(-percent * (cn[x] + cn[y]) // (100 + percent))
        ok = np.minimum(cn[x] - cp[x], cn[y] - cp[y]) >= need
        x, y = x[ok], y[ok]
        begin, many = np.searchsorted(x, np.arange(lo, hi), "left"), np.bincount(x - lo, minlength=hi - lo)
        lines = np.arange(edges[lo], edges[hi])
        own = kind[lines] - lo
        for p, q in _chunks(many[own]):
            each = many[own[p:q]]
            a = np.repeat(lines[p:q], each)
            b = y[np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(begin[own[p:q]], each)]
            at, end = start[b], np.searchsorted(place, b * wide + rank[a], "left")
            some = end > at
            if some.any():
                yield a[some], at[some], end[some]


def _chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to PAIRS, about."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS, prepend=0)).tolist()
    edges = sorted({0, *edges, len(sizes)})
    return zip(edges, edges[1:])


def _together(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], lines: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same (a, lo, hi) of so many lines a at a time, at most, each whole."""
    for a, lo, hi in found:
        part = np.cumsum(np.diff(a, prepend=a[:1]) != 0) // lines
        edges = [0, *np.flatnonzero(np.diff(part, prepend=0)).tolist(), len(a)]
        for i, j in zip(edges, edges[1:]):
            yield a[i:j], lo[i:j], hi[i:j]


def candidates(dealt: DataFrame, percent: int, most: int, only: np.ndarray | None) -> DataFrame:
    """(a, b, na, nb, a_doc, a_pos, b_doc, b_pos, turn, more): pairs of sets, b the earlier, that pass the filters; and, with
    b null, every line (a_doc, a_pos) with its set a.

    A set a gets its `most` earliest candidates of every word, numbered by turn; more: it had others. only: the sets that are asked about, all if None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]
        for batch in batches:
            for ids, cell, marks in zip(*(batch.column(c) for c in ("ids", "cell", "marks"))):
                ids, cell, marks = _unpacked(ids.as_py()), cell.as_py(), marks.as_py()
                if marks is None:
                    doc, number, high, low = _spread(cell, 4)
                    none = pa.nulls(len(doc), pa.int64())
                    if only is None:
                        yield pa.RecordBatch.from_arrays([pa.array(_sets(high, low)), none, none, none, pa.array(ids[doc]), pa.array(number), none, none, none, pa.nulls(len(doc), pa.bool_())], schema=ARROW)
                    continue
                doc, number, high, low, word, pos, n = _spread(cell, 7)
                for out, x in zip(cols, (number, word, pos, n, ids[doc], _sets(high, low), _marks(marks, n))):
                    out.append(x)
        if cols[0]:
            yield from paired(cols)
        textkit.release()

    def paired(cols):
        number, word, pos, n, owner, sets, wide = (np.concatenate(x) for x in cols)
        cols.clear()
        # words that one line has are of no use; most are such
        order = np.argsort(word)
        alone = np.ones(len(order), bool)
        same = word[order[1:]] == word[order[:-1]]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        keep = np.sort(order[~alone])
        number, word, pos, n, owner, sets, wide = (x[keep] for x in (number, word, pos, n, owner, sets, wide))
        order = np.lexsort((number, owner, sets, word))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(word[order]).astype(bool) | np.diff(sets[order]).astype(bool)
        order = order[new]  # a set counts once for a word, as its earliest line
        order = order[np.lexsort((number[order], owner[order], word[order]))]
        w = word[order]
        start = np.flatnonzero(np.diff(w, prepend=-1))
        size = np.diff(np.append(start, len(w)))
        order = order[np.repeat(size > 1, size)]
        rank = np.arange(len(order))  # by word, and there from the earliest line
        by = np.lexsort((rank, pos[order], n[order], word[order]))
        order, rank = order[by], rank[by]
        w, n, pos, wide, sets, owner, number = (x[order] for x in (word, n, pos, wide, sets, owner, number))
        half = wide[:, :2] ^ wide[:, 2:]
        marks = half[:, 0] ^ half[:, 1]
        hits, got, held = np.zeros(len(w), np.int64), [], 0
        place = places(w, n, pos, rank)
        base = np.minimum.reduceat(rank, edge := np.flatnonzero(np.diff(w, prepend=-1))) if len(w) else rank
        base = np.repeat(base, np.diff(np.append(edge, len(w)))) if len(w) else rank
        def leave():
            a, b, turn = (np.concatenate(z) for z in zip(*got))
            more = hits[a] > most
            order = np.lexsort((turn, ~more, sets[b], sets[a]))  # a pair that several words show counts once
            a, b, turn, more = a[order], b[order], turn[order], more[order]
            new = np.ones(len(a), bool)
            new[1:] = (sets[a][1:] != sets[a][:-1]) | (sets[b][1:] != sets[b][:-1])
            a, b, turn, more = a[new], b[new], turn[new], more[new]
            columns = sets[a], sets[b], n[a], n[b], owner[a], number[a], owner[b], number[b], turn.astype(np.int64), more
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=ARROW)

        for a, at, end in _together(partners(w, n, pos, rank, place, percent), TOGETHER):
            if only is not None:
                asked = np.isin(sets[a], only)
                a, at, end = a[asked], at[asked], end[asked]
            reach = WINDOW
            while len(a):  # the word's earliest lines first, then twice as many, and so on
                stop = np.minimum(end, np.searchsorted(place, place[at] - rank[at] + base[a] + reach, "left"))
                for lo, hi in _chunks(stop - at):
                    each = stop[lo:hi] - at[lo:hi]
                    x = np.repeat(a[lo:hi], each)
                    y = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(at[lo:hi], each)
                    total = n[x] + n[y]
                    room = total - 2 * -(-percent * total // (100 + percent))  # what is in one set alone
                    ok = np.bitwise_count(marks[x] ^ marks[y]) <= room
                    for least_n, longer in ((FEW, half), (MANY, wide)):
                        far = np.flatnonzero(ok & (n[x] > least_n) & (n[y] > least_n))
                        ok[far] = np.bitwise_count(longer[x[far]] ^ longer[y[far]]).sum(1, dtype=np.int64) <= room[far]
                    x, y = x[ok], y[ok]
                    by = np.lexsort((rank[y], x))
                    x, y = x[by], y[by]
                    own, first, count = np.unique(x, return_index=True, return_counts=True)
                    turn = np.arange(len(x)) - np.repeat(first, count) + hits[x] + 1
                    hits[own] += count
                    full = turn <= most
                    got.append(tuple(z[full].astype(np.int32) for z in (x, y, turn)))
                    held += int(np.count_nonzero(full))
                go = (stop < end) & (hits[a] <= most)
                a, at, end, reach = a[go], stop[go], end[go], 2 * reach
            if held >= LEAVING:
                yield leave()
                got, held = [], 0
        if got:
            yield leave()

    return dealt.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} {'boolean' if c == 'more' else 'long'}" for c in PAIR))


def full_sets(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(id, items) of the wanted lines (doc_id, pos): the set's hash and its words' hashes, sorted."""

    @textkit.released
    def run(batches):
        none = np.zeros(SLOTS, np.uint32)
        for batch, buf, off in textkit.parts(batches):
            x = line_sets(buf, off, none, least)
            pick = _picked(x, batch.column(2).to_pylist())
            size = x["n"][pick]
            at = np.repeat(x["first"][pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            # with no rarities known the words stand in the order of their hashes
            yield pa.RecordBatch.from_arrays([pa.array(x["set"][pick].view(np.int64)), textkit.to_binary(x["words"][at], size)], ["id", "items"])

    return _asked(docs, wanted).mapInArrow(run, "id long, items binary").dropDuplicates(["id"])


def verify(docs: DataFrame, asking: DataFrame, percent: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(a, lines): the sets that are similar to an earlier one they are paired with, and their lines (doc_id, pos)."""
    wanted = asking.select(F.col("a_doc").alias("doc_id"), F.col("a_pos").alias("pos")).union(asking.select("b_doc", "b_pos")).distinct()
    items = store.cut(full_sets(docs, wanted, least))
    pairs = store.cut(asking.select("a", "b", "na", "nb").distinct())
    hot = store.cut(hot_pivots(pairs))  # the earliest line of a family stands in very many pairs
    near = overlap(pairs, items, None if hot.isEmpty() else store.side(hot)).filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))
    hit = store.cut(near.select("a").distinct())
    where = asking.groupBy("a").agg(F.min(F.struct("a_doc", "a_pos")).alias("at"))
    return hit, where.join(hit, "a").select(F.col("at.a_doc").alias("doc_id"), F.col("at.a_pos").alias("pos"))


def later_lines(docs: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, gone): numbers of the lines that have a similar earlier line; docs: (doc_id, text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, count = max(1, size // bucket_bytes), rarity(docs)
    pairs = store.cut(candidates(prefixes(docs, count, percent, least, buckets), percent, SECOND_ROUND, None))
    lines = pairs.filter("b IS NULL").select(F.col("a_doc").alias("doc_id"), F.col("a_pos").alias("pos"), F.col("a").alias("line"))
    pairs = pairs.filter("b IS NOT NULL")
    firsts = store.cut(lines.groupBy("line").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("line", "first"))
    gone = lines.join(store.side(firsts), "line").filter(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", "pos")
    hit, found = verify(docs, pairs.filter(F.col("turn") <= FIRST_ROUND), percent, least)
    gone = gone.union(found)
    # lines that are open still are few, unlike pairs, which stay where they are
    pairs = pairs.filter((F.col("turn") > FIRST_ROUND) | F.col("more"))
    pairs = store.cut(store.semi(pairs, store.cut(pairs.select("a").distinct().join(hit, "a", "left_anti")), "a"))
    if not (asking := pairs.filter(F.col("turn") > FIRST_ROUND)).isEmpty():
        hit, found = verify(docs, asking, percent, least)
        gone = gone.union(found)
        open_ = store.cut(pairs.filter("more").join(hit, "a", "left_anti").groupBy("a").agg(F.min(F.struct("a_doc", "a_pos")).alias("at")))
        if not open_.isEmpty():  # few lines as a rule: all that share a prefix word with them are dealt again
            where = open_.select(F.col("at.a_doc").alias("doc_id"), F.col("at.a_pos").alias("pos"))
            names = store.cut(prefix_names(docs, where, count, percent, least))
            again = prefixes(docs, count, percent, least, buckets, _sent(names))
            all_pairs = candidates(again, percent, 1 << 41, _sent(open_.select("a"))).filter("b IS NOT NULL")
            gone = gone.union(verify(docs, store.cut(all_pairs.join(open_.select("a"), "a", "left_semi")), percent, least)[1])
    return gone.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))


def _sent(ids: DataFrame) -> np.ndarray | None:
    """The one column's values, sorted, if they are small enough to be sent to all tasks; else None, which asks about everything."""
    return np.sort(ids.toPandas().to_numpy().ravel()) if store.size_of(ids) <= store.BROADCAST_BYTES else None


ADDED = ["n_lines", "n_removed", "removed_lines", "kept_text"]


def deduplicate(docs: DataFrame, percent: int = PERCENT, least: int = MIN_WORDS, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns n_lines, n_removed, removed_lines (numbers from 0) and kept_text added.

    Lines are parted by \\n; lines of fewer than `least` distinct words always stay, with EVERY only those
    without a word. Words have A-Z lower-cased. Two lines are similar if 100 * |A & B| >= percent * |A | B|.
    Null and empty texts have no lines. Rows that repeat an id and text get the same result; of rows with one id and
    different texts, lines count as earlier by their number alone, and a number that goes in one goes in all. Rows with a null id
    keep their text whole and remove nothing. Very long texts and lines are looked at whole. An empty table gives no rows. Other columns pass
    through whatever their names are, but for those named like an added one, which it replaces.
    """
    plain = store.small_batches(docs).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gone = store.cut(later_lines(plain, percent, least, bucket_bytes))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = rows.join(store.side(gone), "doc_id", "left")
    drop = F.coalesce("gone", F.array().cast("array<long>"))
    parts = F.split("text", "\n")
    kept = F.when(F.size(drop) > 0, F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(drop, i.cast("long"))), "\n")).otherwise(F.col("text"))
    n = F.when(F.col("text") == "", 0).otherwise(F.size(parts)).cast("long")
    added = [n.alias("n_lines"), F.size(drop).cast("long").alias("n_removed"), F.sort_array(drop).alias("removed_lines"), kept.alias("kept_text")]
    out = out.select("row", F.struct(*added).alias("added"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED), "added.*")


#: DuckDB SQL for the registered query: each set of words joined by the words in its prefix, the rarest ones, and compared in full.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d WHERE text <> ''
), w AS (
  SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words FROM l
), s AS (
  SELECT words, min((doc_id, pos)) AS first, len(words) AS n, row_number() OVER () AS id FROM w WHERE len(words) > 0 GROUP BY words
), u AS (
  SELECT id, n, first, unnest(words) AS word FROM s
), f AS (
  SELECT word, count(*) AS c FROM u GROUP BY word
), p AS (
  SELECT id, n, first, word FROM u JOIN f USING (word)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY c, word) <= n - ((80 * n + 99) // 100) + 1
), c AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND b.first < a.first AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), j AS (
  SELECT x.id, x.n AS nx, y.n AS ny, len(list_intersect(x.words, y.words)) AS shared FROM c JOIN s x ON c.a = x.id JOIN s y ON c.b = y.id
), g AS (
  SELECT DISTINCT id FROM j WHERE 100 * shared >= 80 * (nx + ny - shared)
), r AS (
  SELECT doc_id, pos FROM w JOIN s USING (words) WHERE (doc_id, pos) > first OR id IN (SELECT id FROM g)
), k AS (
  SELECT l.*, r.pos IS NOT NULL AS gone FROM l LEFT JOIN r USING (doc_id, pos)
)
SELECT d.doc_id, count(k.pos)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  coalesce(string_agg(pos::VARCHAR, ',' ORDER BY pos) FILTER (WHERE gone), '') AS removed_lines,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
"""
