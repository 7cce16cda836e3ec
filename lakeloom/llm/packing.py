"""Packing tokenised documents into sequences by first-fit decreasing.

The first bin that fits is found with a tournament tree: its leaves are the bins' free capacities,
an inner node is the larger of its two children, and one walk from the root finds the leftmost leaf
with enough room. Groups of documents, drawn by a hash of the id, are packed independently.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit

LENGTH = 4096
END_ID = 2
#: Documents of a group, about: its last bins stay open, so padding falls with the group's size.
GROUP_DOCS = 2000
CLOSING = np.isin(np.arange(256), list(b".,;:!?"))
ALNUM = np.isin(np.arange(256), list(range(97, 123)) + list(range(48, 58)))


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in the bin) of each item; items go by falling size, ties in the given order."""
    n = len(sizes)
    width = 1 << max(1, n - 1).bit_length()
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        need, at = int(sizes[i]), 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[i], offsets[i] = at - width, capacity - tree[at]
        tree[at] -= need
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
    return bins, offsets


class WordTokens:
    """Ids of texts by a lower-casing tokenizer that never joins characters over white space, nor
    letters and digits with the punctuation that follows them.

    Words are cut before their closing ASCII punctuation, each distinct piece is tokenised once for a
    task, and the texts' ids are put together from the pieces' ids. The pieces known are kept up to a
    number, so memory is bounded. Control marks, such as <|endoftext|>, get their own ids, as the tokenizer
    gives them; it looks for them before it lowers letters, so words that may hold one keep theirs.
    """

    def __init__(self, path: str, keep: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep = keep
        # a piece of ASCII letters is one unit of the model, as checked here, and can go to it directly
        self.direct = all(self.encode(x) == self.units(x) for x in ("a", "them", "ofthstthor", "xqzvwk"))
        self.known, self.at, self.flat = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def units(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def learn(self, fresh: np.ndarray, texts: list[str]) -> None:
        ids = [self.units(x) if self.direct and x.isascii() and x.isalpha() else self.encode(x) for x in texts]
        size = np.concatenate([np.diff(self.at), np.fromiter(map(len, ids), np.int64, len(ids))])
        flat = np.concatenate([self.flat, np.fromiter((x for i in ids for x in i), np.uint32)])
        both = np.concatenate([self.known, fresh])
        order = np.argsort(both, kind="stable")
        starts = np.cumsum(size) - size
        self.known, size = both[order], size[order]
        self.at = np.concatenate([[0], np.cumsum(size)])
        self.flat = flat[np.arange(self.at[-1]) + np.repeat(starts[order] - self.at[:-1], size)]

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        n = len(off) - 1
        s, e, d = textkit.words(buf, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        marks = np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|")))
        held = np.zeros(len(buf) + 1, np.int8)
        marked = np.unique(np.searchsorted(s, marks, "right") - 1)
        held[s[marked]] += 1
        held[e[marked]] -= 1
        buf = np.where(np.cumsum(held[:-1]) > 0, buf, textkit.LOWER[buf]) if len(marks) else textkit.LOWER[buf]
        # the closing run of punctuation, if a letter or digit stands before it
        plain = ~CLOSING[buf]
        last = np.maximum.accumulate(np.where(plain, np.arange(len(buf)), -1))[e - 1]
        cut = (last >= s) & (last < e - 1) & ALNUM[buf[np.maximum(last, 0)]]
        mid = last[cut] + 1
        place = np.arange(len(s)) + np.cumsum(cut) - cut
        starts, ends, doc = (np.empty(len(s) + len(mid), np.int64) for _ in range(3))
        starts[place], ends[place], doc[place] = s, e, d
        ends[place[cut]] = mid
        starts[place[cut] + 1], ends[place[cut] + 1], doc[place[cut] + 1] = mid, e[cut], d[cut]
        h = textkit.hash_spans(textkit.prefix_hash(buf), starts, ends)
        kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
        new = ~np.isin(kinds, self.known, assume_unique=True)
        if len(self.known) + new.sum() > self.keep:
            new[:] = True
            self.known = self.known[:0]
            self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        if new.any():
            raw = buf.tobytes()
            self.learn(kinds[new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
        at = np.searchsorted(self.known, kinds)
        size, begin = np.diff(self.at)[at], self.at[at]
        each = size[back]
        total = np.cumsum(each)
        ids = self.flat[np.arange(total[-1]) + np.repeat(begin[back] - total + each, each)]
        return ids, np.bincount(doc, weights=each, minlength=n).astype(np.int64)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, serial): whole sequences' worth of a document's ids, then what is left.

    serial numbers a task's pieces, so that rows which are alike need not lie together.
    """

    @textkit.released
    def run(batches):
        encode, serial = WordTokens(path), 0
        for batch, buf, off in textkit.parts(batches, limit=textkit.PART_BYTES // 2):
            ids, count = encode(buf, off)
            name, rows, lo = batch.column(0).to_pylist(), [], 0
            for x, n in zip(name, count.tolist()):
                own = np.append(ids[lo : lo + n], np.uint32(end_id)).astype("<u4")
                lo += n
                for start in range(0, n + 1, length):
                    rows.append((x, start, min(length, n + 1 - start), zlib.crc32(own[start : start + length]), n + 1))
            numbers = np.arange(serial, serial := serial + len(rows))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(numbers)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "serial"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, serial long")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group_docs: int = GROUP_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is one piece with the end id alone. A document is cut after every `length`
    ids; what is left stays whole. Repeated ids are packed as often as they stand, in groups of
    their own each; a null id keeps its row. Very long texts are cut like others, and their pieces may lie in any groups. Other
    columns don't matter; an empty table gives no rows. sequence_id is the group's number times 2^32 plus the bin's; offsets are gapless from 0.
    """
    groups = max(1, store.small_batches(docs).count() // group_docs)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32", "serial"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=pdf["grp"].to_numpy() * 2**32 + bins, offset=offsets).drop(columns=["grp", "serial"])

    group = F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "start", "ids_crc32", "serial"), F.lit(groups))
    cut = pieces(docs, path, length, end_id, id_col, text_col).withColumn("grp", group)
    return cut.groupBy("grp").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
