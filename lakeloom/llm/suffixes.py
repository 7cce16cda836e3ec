"""Exact removal of long repeated strings, by blockwise suffix sorting with difference covers.

Asked is which suffixes share their first `length` bytes with one that starts earlier. Of any two starts i, j
some shift d < V takes both into a difference cover modulo V. This is used twice.

First, two equal strings of `length` bytes hold two equal cover samples of length - V + 1 bytes at the same place.
The samples' names are dealt, and suffixes without a tied sample within their first V bytes are never sorted.
The others go to tasks by their string's least 8-byte name, which neighbours mostly share, so that a
run of suffixes travels as one piece of text.

Then each task sorts its suffixes. The ranks of its cover samples are computed beforehand, by their bytes, to a depth of
`length` or more. One bucket of suffixes with common first bytes is sorted at a time, by W bytes; what is tied
there is ordered by the ranks of the samples at the shift that the two starts share. So no comparison looks at more
than W bytes and two ranks, and besides the text and the samples' ranks only one bucket is held. Suffixes that are
equal to the depth stand in a row, which is confirmed on their bytes; the earliest of them stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit
from .language_model import _spread, _squeeze

LENGTH = 100
#: A perfect difference set; every residue modulo 57 is a difference of two of them.
COVER, V = np.array([0, 1, 3, 13, 32, 36, 43, 52]), 57
SORT_COVER, W = np.array([3, 6, 7, 12, 14]), 21
SEED_BYTES = 8
#: Text bytes whose samples, or sorted suffixes, one task holds at once, about.
BUCKET_BYTES = 6 << 20
#: Suffixes of a bucket that is sorted at once, about.
BLOCK = 1 << 18
_NAME = np.uint64((1 << 40) - 1)


def _sample_names(buf: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, start in the buffer, document number) of all cover samples that fit into their document."""
    width = length - V + 1
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inner = np.arange(len(buf)) - off[doc]
    covered = np.zeros(V, bool)
    covered[COVER] = True
    at = np.flatnonzero(covered[inner % V] & (np.arange(len(buf)) + width <= off[doc + 1]))
    return textkit.hash_spans(textkit.prefix_hash(buf), at, at + width), at, doc[at]


def tied_samples(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(id, names): of every text the cover samples whose name another sample has, too."""

    @textkit.released
    def deal(batches):
        for batch, buf, off in textkit.parts(batches):
            ids = batch.column(0).to_numpy().astype("<i8")
            name, _, doc = _sample_names(buf, off, length)
            order = np.argsort(name)
            name, doc = name[order], doc[order]
            same = name[1:] == name[:-1]
            tied = np.zeros(len(name), bool)
            tied[1:] |= same
            tied[:-1] |= same
            first = np.ones(len(name), bool)
            first[1:] = ~same
            # what is tied here is so known; the bucket needs it once, to tie others' samples to it
            know, where = np.flatnonzero(tied), (name % np.uint64(buckets)).astype(np.int64)
            know = know[np.argsort(doc[know], kind="stable")]
            kinds, start = np.unique(doc[know], return_index=True)
            if len(kinds):
                yield pa.RecordBatch.from_arrays([pa.array(ids[kinds] % buckets), pa.array(ids[kinds]), textkit.to_binary(name[know], np.diff(np.append(start, len(know))))], ["bucket", "id", "cell"])
            send = np.flatnonzero(first)
            send = send[np.argsort(where[send], kind="stable")]
            edge = np.searchsorted(where[send], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edge)):
                k = send[edge[b] : edge[b + 1]]
                short = np.sort(((name[k] >> np.uint64(20) & _NAME) << np.uint64(22)) | np.arange(len(k), dtype=np.uint64))
                k = k[(short & np.uint64((1 << 22) - 1)).astype(np.int64)]
                short = (short >> np.uint64(22)).astype(np.int64)
                own, at = textkit.own_ids(ids, doc[k])
                rows.append((int(b), (len(own) // 8).to_bytes(8, "little") + own + _squeeze(np.diff(short, prepend=0), at * 2 + tied[k])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "id", "cell"])

    @textkit.released
    def rank(table):
        known = table.filter(table.column("id").is_valid())
        names = [np.frombuffer(c.as_buffer(), np.uint64) for c in known.column("cell")]
        ids = [np.full(len(x), i, np.int64) for i, x in zip(known.column("id").to_pylist(), names)]
        name, owner, several = [], [], []
        for cell in table.filter(table.column("id").is_null()).column("cell"):
            cell = cell.as_py()
            n = int.from_bytes(cell[:8], "little")
            step, doc = _spread(cell[8 + 8 * n :], 2)
            name.append(np.cumsum(step))
            owner.append(np.frombuffer(cell, "<i8", n, 8)[doc // 2])
            several.append(doc & 1)
        if name:
            name, owner, several = np.concatenate(name), np.concatenate(owner), np.concatenate(several)
            order = np.argsort(name)
            name, owner, several = name[order], owner[order], several[order]
            same = name[1:] == name[:-1]
            tied = np.zeros(len(name), bool)
            tied[1:] |= same
            tied[:-1] |= same
            k = tied & (several == 0)
            # a bucket is told names by their middle bits; as a set of these they go back
            names.append(name[k].astype(np.uint64) | np.uint64(1 << 63))
            ids.append(owner[k])
        ids, names = np.concatenate(ids), np.concatenate(names)
        where = ids % groups
        order = np.argsort(where, kind="stable")
        size = np.bincount(where, minlength=groups)
        full = np.flatnonzero(size)
        return pa.table({"grp": full, "ids": textkit.to_binary(ids[order], size[full]), "names": textkit.to_binary(names[order], size[full])})

    @textkit.released
    def by_text(table):
        ids, names = (np.concatenate([np.frombuffer(c.as_buffer(), t) for c in table.column(k)]) for k, t in (("ids", np.int64), ("names", np.uint64)))
        order = np.argsort(ids, kind="stable")
        who, start = np.unique(ids[order], return_index=True)
        return pa.table({"id": who, "names": textkit.to_binary(names[order], np.diff(np.append(start, len(ids))))})

    groups = max(1, buckets // 16)
    dealt = texts.mapInArrow(deal, "bucket long, id long, cell binary")
    ranked = dealt.groupBy("bucket").applyInArrow(rank, "grp long, ids binary, names binary")
    return ranked.groupBy("grp").applyInArrow(by_text, "id long, names binary")


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    n = len(x) - w + 1
    pad = np.append(x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, w)
    ahead = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(ahead[:n], np.minimum.accumulate(pad, 1).ravel()[w - 1 : w - 1 + n])


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place as one number, in the order of the bytes."""
    out = np.zeros(len(buf) - 7, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= buf[k : k + len(out)]
    return out


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _steps(x: np.ndarray) -> np.ndarray:
    """_dense() of values that rise."""
    return np.cumsum(np.diff(x, prepend=x[:1]) != 0)


def sample_ranks(word: np.ndarray, place: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Ranks, by place in the text, of the cover samples: by their first `depth` bytes or more, 1 at least, and 0 elsewhere.

    word: from _words; place: the samples' places, each piece's in its own cover; end: the ends of their pieces, after which 2 W zeros follow.
    A sample's rank to the depth 2 h comes from its own and from the one h bytes on, both to the depth h. h is a
    multiple of W, so that the other is a sample as well; after a piece's end there is nothing, which is the least.
    """
    rank = _dense(word[place])
    for k in (8, W - 8):
        rank = _dense(rank.astype(np.uint64) << np.uint64(32) | _dense(word[place + k]).astype(np.uint64))
    ranks = np.zeros(len(word) + 7, np.int32)
    ranks[place] = rank + 1
    h = W
    while h < depth:
        other = np.where(place + h < end, ranks[np.minimum(place + h, len(ranks) - 1)], 0)
        ranks[place] = _dense(ranks[place].astype(np.uint64) << np.uint64(32) | other.astype(np.uint64)) + 1
        h *= 2
    return ranks


def order_tied(at: np.ndarray, group: np.ndarray, residue: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The places `at` with those of each group ordered by their samples' ranks; group: rising numbers.

    Quicksort of all groups at once: each is parted by a pivot, compared at the shift that takes both into the cover.
    """
    at = at.copy()
    shift = np.full((W, W), -1)
    for d in range(W - 1, -1, -1):
        own = np.isin((np.arange(W) + d) % W, SORT_COVER)
        shift[np.ix_(own, own)] = d
    todo, own = np.arange(len(at)), group
    while True:
        size = np.bincount(own)
        several = size[own] > 1
        todo, own = todo[several], own[several]
        if not len(todo):
            return at
        first = np.flatnonzero(np.diff(own, prepend=-1))
        pivot = at[todo[first + np.diff(np.append(first, len(own))) // 2]]
        mine, other = at[todo], np.repeat(pivot, np.diff(np.append(first, len(own))))
        d = shift[residue[mine], residue[other]]
        side = np.sign(ranks[mine + d] - ranks[other + d]) + 1
        key = _steps(own) * 3 + side
        order = np.argsort(key, kind="stable")
        at[todo], key = mine[order], key[order]
        left = key % 3 != 1  # what equals the pivot is in its place
        todo, own = todo[left], _steps(key[left])


def later_places(buf: np.ndarray, size: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): runs of places whose suffix has the same first `length` bytes as one at an earlier place.

    buf: pieces of `size` bytes, 2 W zeros after each; the first n places of a piece are suffixes, and start is its place in its text.
    """
    first = np.cumsum(size + 2 * W) - size - 2 * W
    residue, is_sample, is_suffix = (np.zeros(len(buf), t) for t in (np.int8, bool, bool))
    piece = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(size) - size, size)
    where = first[piece] + inside
    residue[where] = (start[piece] + inside) % W
    is_sample[where] = np.isin(np.arange(W), SORT_COVER)[residue[where]]
    is_suffix[where[inside < n[piece]]] = True
    ends = np.repeat(first + size, size)[is_sample[where]]
    del piece, inside, where
    word = _words(buf)
    ranks = sample_ranks(word, np.flatnonzero(is_sample), ends, length)
    places = np.flatnonzero(is_suffix)
    head = buf[places].astype(np.int64) << 8 | buf[places + 1]
    total = np.cumsum(np.bincount(head, minlength=1 << 16))
    block = (np.maximum(total, 1) - 1)[head] // BLOCK
    later = np.zeros(len(buf), bool)
    for b in np.unique(block):
        at = places[block == b]
        words = [word[at + k] for k in (0, 8, W - 8)]
        order = np.lexsort(words[::-1])
        at, words = at[order], [w[order] for w in words]
        new = np.ones(len(at), bool)
        new[1:] = np.any([w[1:] != w[:-1] for w in words], axis=0)
        at = order_tied(at, np.cumsum(new) - 1, residue, ranks)
        for k in [*range(W - 8, length - 8, 8), length - 8]:  # equal to the depth?
            w = word[at + k]
            new[1:] |= w[1:] != w[:-1]
        kind = np.flatnonzero(new)
        later[at] = True
        later[np.minimum.reduceat(at, kind)] = False
    return textkit.runs(later, np.append(first, len(buf)))


def later_runs(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(id, start, n) from (id, text, names): n suffixes in a row whose first `length` bytes start earlier elsewhere."""
    width = length - V + 1

    @textkit.released
    def deal(batches):
        for batch, buf, off in textkit.parts(batches):
            if len(buf) < length:
                continue
            ids = batch.column(0).to_numpy().astype("<i8")
            name, at, doc = _sample_names(buf, off, length)
            tied = np.zeros(len(at), bool)
            edge = np.searchsorted(doc, np.arange(len(ids) + 1))
            for i, cells in enumerate(batch.column(2).to_pylist()):
                k = slice(edge[i], edge[i + 1])
                got = np.frombuffer(cells, np.uint64)
                short = got[got >> np.uint64(63) == 1] & np.uint64((1 << 63) - 1)
                tied[k] = np.isin(name[k], got) | np.isin(name[k] >> np.uint64(20) & _NAME, short)
            # suffixes that reach a tied sample within V bytes
            near = np.zeros(len(buf) + 1, np.int64)
            np.add.at(near, np.maximum(at[tied] - V + 1, off[doc[tied]]), 1)
            np.add.at(near, at[tied] + 1, -1)
            owner = np.repeat(np.arange(len(ids)), np.diff(off))
            start = np.arange(len(buf) - length + 1)
            pick = (np.cumsum(near)[: len(start)] > 0) & (start + length <= off[owner[: len(start)] + 1])
            if not pick.any():
                continue
            h = textkit.prefix_hash(buf)
            seeds = np.arange(len(buf) - SEED_BYTES + 1)
            least = _least(textkit.hash_spans(h, seeds, seeds + SEED_BYTES), length - SEED_BYTES + 1)
            new = pick.copy()
            new[1:] &= ~(pick[:-1] & (least[1:] == least[:-1]) & (owner[1 : len(start)] == owner[: len(start) - 1]))
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            n = np.bincount(group[pick], minlength=len(first))
            end = first + n + length - 1
            # equal pieces: the earliest goes on, the others are known to be later
            key, raw = textkit.hash_spans(h, first, end), buf.tobytes()
            order = np.lexsort((first, ids[owner[first]], key))
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(len(first), bool)
            again[order[1:][same]] = [raw[first[i] : end[i]] == raw[first[j] : end[j]] for i, j in zip(order[1:][same].tolist(), order[:-1][same].tolist())]
            at_, n_ = first - off[owner[first]], n
            where = np.where(again, ids[owner[first]] % buckets, (least[first] % np.uint64(buckets)).astype(np.int64))
            order = np.lexsort((again, where))
            edge = np.searchsorted(where[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edge)):
                k = order[edge[b] : edge[b + 1]]
                go = k[~again[k]]
                text = b"".join([raw[i:j] for i, j in zip(first[go], end[go])])
                rows.append((int(b), _squeeze(at_[k], n_[k], again[k]), ids[owner[first[k]]].tobytes(), len(text).to_bytes(8, "little") + pa.compress(text or b"\0", codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "cell", "ids", "pieces"])

    @textkit.released
    def sort(table):
        starts, counts, owners, texts_, done = [], [], [], [], []
        for cell, ids, pieces in zip(*(table.column(c).to_pylist() for c in ("cell", "ids", "pieces"))):
            a, n, again = _spread(cell, 3)
            starts.append(a), counts.append(n), owners.append(np.frombuffer(ids, "<i8")), done.append(again > 0)
            size = int.from_bytes(pieces[:8], "little")
            texts_.append(pa.decompress(pieces[8:], max(size, 1), codec="zstd", asbytes=True)[:size])
        start, n, owner, again = (np.concatenate(x) for x in (starts, counts, owners, done))
        out = [np.flatnonzero(again)], [start[again]], [n[again]]
        go = np.flatnonzero(~again)
        if len(go):
            size = n[go] + length - 1
            from_ = np.cumsum(size) - size
            order = np.lexsort((start[go], owner[go]))  # earlier pieces first, so that a place in the text tells what is earlier
            go, size, from_ = go[order], size[order], from_[order]
            raw, gap = b"".join(texts_), b"\0" * (2 * W)
            del texts_
            buf = np.frombuffer(gap.join([raw[i : i + k] for i, k in zip(from_.tolist(), size.tolist())]) + gap, np.uint8)
            s, e = later_places(buf, size, start[go], n[go], length)
            piece = np.searchsorted(np.cumsum(size + 2 * W), s, "right")
            inner = s - (np.cumsum(size + 2 * W) - size - 2 * W)[piece]
            out[0].append(go[piece]), out[1].append(start[go][piece] + inner), out[2].append(e - s)
        who, at, n = (np.concatenate(x) for x in out)
        return pa.table({"id": owner[who], "start": at.astype(np.int64), "n": n.astype(np.int64)})

    dealt = texts.mapInArrow(deal, "bucket long, cell binary, ids binary, pieces binary")
    return dealt.groupBy("bucket").applyInArrow(sort, "id long, start long, n long")


def spans_removed(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans that the strings of the runs cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((r["start"], r["start"] + r["n"] - 1 + length) for r in runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def deduplicate(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256), one row per row of docs.

    A byte goes if it lies in a string of `length` bytes that also starts earlier, in a smaller doc_id or
    earlier in the same text; strings are judged on the input and may overlap. spans: the removed byte
    spans. Null and empty texts have no bytes. A text that another document with a smaller id has as
    well goes as a whole. Rows that repeat an id and text count as one document, and of several
    texts under one id the one with the smallest digest counts as the earliest; a null id comes before all others.
    Very long texts are looked at whole. An empty table gives no rows; other columns, whatever their names, are not looked at.
    """
    if length < V + SEED_BYTES:
        raise ValueError(f"length must be at least {V + SEED_BYTES}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("digest"))
    facts = store.cut(rows.select("doc_id", "digest", F.octet_length("text").alias("n_bytes")))
    seen = facts.agg(F.count("*"), F.count_distinct("doc_id"), F.sum("n_bytes")).first()
    if seen[0] != seen[1]:
        from ..operators.keys import add_surrogate_key

        keys = store.cut(add_surrogate_key(facts.select("doc_id", "digest").distinct(), "id", ["doc_id", "digest"]))
        match = lambda a: a.join(keys.withColumnsRenamed({"doc_id": "kid", "digest": "kdigest"}), F.col("doc_id").eqNullSafe(F.col("kid")) & (F.col("digest") == F.col("kdigest")))
        rows, facts = match(rows).select("id", "doc_id", "text", "digest"), match(facts).select("id", "doc_id", "digest", "n_bytes")
    else:
        rows, facts = rows.withColumn("id", F.col("doc_id")), facts.withColumn("id", F.col("doc_id"))
    buckets = max(1, (seen[2] or 0) // bucket_bytes)
    first = facts.filter(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("id").alias("first"), F.count_distinct("id").alias("c")).filter("c > 1")
    copies = store.cut(facts.join(store.cut(first), "digest").filter("id <> first").select("id").distinct())
    single = rows.filter(F.octet_length("text") >= length).select("id", "text")
    single = single.join(store.side(copies), "id", "left_anti")
    if seen[0] != seen[1]:
        single = single.dropDuplicates(["id"])
    tied = store.cut(tied_samples(single, length, buckets))
    near = store.semi(single, tied.select("id"), "id").join(tied, "id").select("id", "text", "names")
    later = store.cut(later_runs(near, length, buckets).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("runs")))

    def measure(batches):
        for batch in batches:
            out = []
            for text_, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, at, kept = text_.encode(), 0, hashlib.sha256()
                spans = spans_removed(runs, length)
                for s, e in spans:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                out.append((len(raw), sum(e - s for s, e in spans), len(spans), [{"start": s, "end": e} for s, e in spans], kept.hexdigest()))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    touched = store.semi(rows, later.select("id"), "id").join(later, "id").select("doc_id", "text", "runs").mapInArrow(measure, schema)
    known = later.select("id").union(copies)
    untouched = rows.join(store.side(known), "id", "left_anti")
    n = F.octet_length("text").cast("long")
    none = F.array().cast("array<struct<start: long, end: long>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end")))
    zero = F.lit(0).cast("long")
    return (
        touched.unionByName(untouched.select("doc_id", n.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), none.alias("spans"), F.sha2("text", 256).alias("kept_sha256")))
        .unionByName(facts.join(copies, "id", "left_semi").select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), F.col("n_bytes").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), whole.alias("spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256")))
    )


#: DuckDB SQL for the registered query: every string of 100 bytes in hexadecimal, by its MD5.
ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), p AS (
  SELECT doc_id, h, len(h) // 2 - 99 AS n, unnest(range(0, len(h) // 2 - 99, 256)) AS j FROM t
), q AS (
  SELECT doc_id, n, j, substr(h, 2 * j + 1, 710) AS part FROM p
), s AS (
  SELECT doc_id, j, part, unnest(range(least(256, n - j))) AS o FROM q
), v AS (
  SELECT doc_id, j + o AS i, md5(substr(part, 2 * o + 1, 200)) AS digest FROM s
), m AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY digest ORDER BY doc_id, i) > 1 AS later FROM v
), e AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM m WHERE later
), g AS (
  SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e
), r AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY ALL
), k AS (
  SELECT r.doc_id, run, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS kept, lead(a) OVER w IS NULL AS last, h
  FROM r JOIN t ON r.doc_id = t.doc_id WINDOW w AS (PARTITION BY r.doc_id ORDER BY a)
), x AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(kept || CASE WHEN last THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM k GROUP BY doc_id
)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM t LEFT JOIN x ON t.doc_id = x.doc_id
"""
