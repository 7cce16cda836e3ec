"""Rule statistics of whole texts: counts, and the ratios that the quality models look at."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["log_words", "mean_word", "symbols_word", "upper_char", "digit_char", "bang_word", "stop_word", "dup_line_share", "repeat_share", "distinct_share", "top_share", "words_line", "byte_entropy", "other_end_share"]
#: The symbols that count as such, and the marks that may end a word in plain prose.
SYMBOLS, MARKS = b"#*$%&|<>", b".,;:?!)\"'"


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SYMBOL = _table(SYMBOLS)
IS_PLAIN_END = _table(MARKS) | _table(bytes(range(97, 123)) + bytes(range(65, 91)) + bytes(range(48, 58)) + bytes(range(128, 256)))


def text_stats(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS as integers and RATIOS as floats, one value per text; 0 where a ratio has no base."""
    n = len(off) - 1
    owner = np.repeat(np.arange(n), np.diff(off))
    per = lambda flag: np.bincount(owner[flag], minlength=n)
    h, d, s, e = textkit.word_hashes(buf, off, lower=False)
    n_words = np.bincount(d, minlength=n)
    word_chars = per(textkit.IS_WORD[buf] & ((buf & 0xC0) != 0x80))
    symbols = per(IS_SYMBOL[buf])

    ls, le = textkit.runs(buf != 10, off)
    line_doc = np.searchsorted(off, ls, "right") - 1
    spoken = np.searchsorted(s, le, "left") > np.searchsorted(s, ls, "left")
    ls, le, line_doc = ls[spoken], le[spoken], line_doc[spoken]
    lh = textkit.hash_spans(textkit.prefix_hash(buf), ls, le)
    n_lines = np.bincount(line_doc, minlength=n)
    order = np.lexsort((lh, line_doc))
    again = (lh[order][1:] == lh[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    n_dup = np.bincount(line_doc[order][1:][again], minlength=n)

    w, at = textkit.windows(h, d, 3)
    hit = at[textkit.repeated(w, d[at])]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[hit + k] = True
    n_repeat = np.bincount(d[covered], minlength=n)

    order = np.lexsort((h, d))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (d[order][1:] != d[order][:-1])
    n_distinct = np.bincount(d[order][new], minlength=n)
    top = np.zeros(n, np.int64)
    first = np.flatnonzero(new)
    np.maximum.at(top, d[order][first], np.diff(np.append(first, len(h))))

    entropy = np.zeros(n)
    for lo in range(0, n, 4096):
        hi = min(n, lo + 4096)
        part = slice(off[lo], off[hi])
        hist = np.bincount((owner[part] - lo) * 256 + buf[part], minlength=(hi - lo) * 256).reshape(-1, 256)
        p = hist / np.maximum(hist.sum(1, keepdims=True), 1)
        entropy[lo:hi] = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    odd_end = np.bincount(d[~IS_PLAIN_END[buf[e - 1]]], minlength=n) if len(e) else np.zeros(n)
    values = [n_words, word_chars, symbols, n_dup, n_repeat]
    values += [np.log1p(n_words), word_chars / words, symbols / words, per((buf >= 65) & (buf <= 90)) / chars, per((buf >= 48) & (buf <= 57)) / chars, per(buf == 33) / words, per(_table(b".?!")[buf]) / words]
    values += [n_dup / np.maximum(n_lines, 1), n_repeat / words, n_distinct / words, top / words, n_words / np.maximum(n_lines, 1), entropy, odd_end / words]
    return dict(zip(COUNTS + RATIOS, values))


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS as long, RATIOS as double), one row per row of docs, null and repeated ids kept; a null text has no words, a very long one is looked at whole."""

    @textkit.released
    def run(batches):
        for batch, buf, off in textkit.parts(batches, limit=textkit.PART_BYTES // 2):
            x = text_stats(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[c].astype(np.int64)) for c in COUNTS), *(pa.array(x[c].astype(np.float64)) for c in RATIOS)], ["doc_id", *COUNTS, *RATIOS])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def marked(stats: DataFrame, labels: DataFrame, label: str = "quality", keep=None) -> DataFrame:
    """The statistics of all labelled documents with their label y; a document with several counts with the least. Null
    labels and ids are left out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    both = stats.join(marks, "doc_id")
    return both if keep is None else both.filter(keep)


def labelled(stats: DataFrame, labels: DataFrame, rows: int, label: str = "quality", keep=None) -> tuple[np.ndarray, np.ndarray]:
    """(ratios, labels) of at most `rows` labelled documents, those with the least hashes of their ids.

    They are counted first, and only hashes below a bound for a tenth more than `rows` go on, so what is sorted
    and reaches the driver is bounded, too. Rows that repeat an id are drawn together.
    """
    both = marked(stats, labels, label, keep)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    if (n := both.count()) > rows:
        both = both.filter(draw < F.lit(int(2**63 * min(1.0, (1.1 * rows + 100) / n)) - 1))
    got = both.orderBy(draw, "doc_id").select(*RATIOS, "y").limit(rows).toPandas()
    return got[RATIOS].to_numpy(np.float64), got["y"].to_numpy(np.int64)
