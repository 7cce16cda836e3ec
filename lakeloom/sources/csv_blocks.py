"""CSV with line ends inside quotes, read by many tasks per file.

Whether a line end ends a record is told by the number of quotes before it in the file: if that is odd, it stands
inside a quoted field (a doubled quote counts twice and changes nothing). Files are read line by line in blocks, as any
text is; a first pass counts each block's quotes, their sums over the blocks before tell with which parity a block
begins, and a second pass cuts every block into records by itself. Only what reaches over a block's edge is sent
elsewhere to be put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions import row_bytes
from .scratch import cut

#: Blocks that are told their parity by a broadcast table, up to so many bytes of it, which are counted.
BROADCAST_BYTES = 64 << 20
WHOLE, END, MIDDLE, BEGINNING = 0, 1, 2, 3
PIECE = "file string, block long, part int, text string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _parities(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a block begins inside a quoted field. A row per block comes together by file."""
    quotes = lines.groupBy("file", "block").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return quotes.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(header: bool):
    """Records and pieces of records from a partition's lines, which come in the order of their blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, held, first, skip = None, False, [], False, False

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()))], ["file", "block", "part", "text"])

        def last() -> list[tuple]:
            """What a block leaves open: the beginning of a record, which is at -1 if it is the header, or lines that are all inside one."""
            return [(at[0], -1 if skip else at[1], MIDDLE if first else BEGINNING, "\n".join(held))] if held else []

        for batch in batches:
            files, blocks, flags, values = (batch.column(i) for i in range(4))
            ids, starts = files.dictionary_encode().indices.to_numpy(), blocks.to_numpy()
            edges = np.flatnonzero((np.diff(ids) != 0) | (np.diff(starts) != 0)) + 1
            quotes = pc.count_substring(values, '"').to_numpy()
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                if hi <= lo:
                    continue
                here, out = (files[lo].as_py(), blocks[lo].as_py()), []
                if here != at:
                    out, at, inside, held = last(), here, bool(flags[lo].as_py()), []
                    first, skip = inside, header and here[1] == 0
                after = (int(inside) + np.cumsum(quotes[lo:hi])) % 2 == 1
                before = np.concatenate([[inside], after[:-1]])
                inside = bool(after[-1])
                plain = ~before & ~after  # a record that is one line
                if skip and plain[0]:  # the header, unless it has line ends of its own
                    plain[0] = skip = False
                for k in np.flatnonzero(before | after).tolist():
                    held.append(values[lo + k].as_py())
                    if not after[k]:
                        if skip:
                            skip = False
                        else:
                            out.append((*here, END if first else WHOLE, "\n".join(held)))
                        held, first = [], False
                if out:
                    yield table(out)
                if plain.any():
                    found = values.slice(lo, hi - lo).filter(pa.array(plain))
                    n = len(found)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32)), found], ["file", "block", "part", "text"])
        if at is not None:
            yield table(last())

    return run


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that reach over the edges of blocks, from their pieces: each block has one of each kind at most."""
    order = Window.partitionBy("file").orderBy("block", "part")
    number = pieces.withColumn("record", F.sum(F.when(F.col("part") == BEGINNING, 1).otherwise(0)).over(order))
    parts = F.sort_array(F.collect_list(F.struct("block", "part", "text")))
    joined = number.groupBy("file", "record").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.min("block").alias("at"))
    return joined.filter("at >= 0").select("text")


def read_csv_blocks(spark: SparkSession, path: str | list[str], schema: StructType | str, header: bool = True) -> DataFrame:
    """The rows that `files.read_csv` gives with a schema, but by as many tasks as the files have blocks.

    Quotes are `"`, doubled inside a field; records end with LF or CRLF. Empty lines outside fields are passed over. Line
    ends inside fields stay as they are, also where records end with CRLF (the plain reader makes them LF then). A field that holds a single stray quote shifts the parity of its file, as no reader by blocks can tell; such files are for
    `files.read_csv`. The lines are read twice, once to count quotes.
    """
    lines = _lines(spark, path)
    parities = cut(_parities(lines))
    if (parities.agg(F.sum(row_bytes(parities))).first()[0] or 0) > BROADCAST_BYTES:
        raise ValueError("the files have too many blocks for one read: read them in groups")
    told = lines.join(F.broadcast(parities), ["file", "block"])  # which keeps the order of lines
    pieces = cut(told.select("file", "block", "inside", "value").mapInArrow(_cut(header), PIECE))
    text = pieces.filter(F.col("part") == WHOLE).select("text").unionByName(_joined(pieces.filter(F.col("part") != WHOLE)))
    text = text.select(F.regexp_replace("text", "\r$", "").alias("text")).filter("text <> ''")
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    row = F.from_csv("text", columns, {"quote": '"', "escape": '"', "multiLine": "true"})
    return text.select(row.alias("row")).select("row.*")
