"""Substring dedup by hashing lines, paragraphs or the sentences of lines: the earliest occurrence stays, later ones go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Where a text is parted, by the kind of unit. Every unit keeps the separator that ends it.
PARTED = {"line": r"(?<=\n)", "paragraph": r"(?<=\n\n)", "sentence": r"(?<=\n)|(?<=[.!?][ \t])"}
#: What the registered query asks for: passages begin and end within lines, so lines are parted into sentences;
#: later ones go where so many words in a row stand earlier. Half a passage of 50 words shows even if
#: its ends are grown into other sentences, and short phrases that clean texts share stay.
UNIT, RUN_WORDS = "sentence", 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(unit: Column) -> Column:
    """A-Z in lower case, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def later_units(rows: DataFrame, unit: str, run_words: int) -> DataFrame:
    """(doc_id, body, pos, gone): places of all later units in rows (doc_id, body, text), and whether they are to be removed.

    A unit is later if its normal form stands earlier, by (doc_id, body, pos). Units without a word
    are passed over. Later units in a row are a run, which goes if it has `run_words` words.
    """
    spoken = F.filter(F.transform(F.split("text", PARTED[unit]), lambda x, i: F.struct(i.alias("pos"), x.alias("unit"))), lambda u: u["unit"].rlike(r"[^\x20\x09-\x0D]"))
    units = rows.select("doc_id", "body", F.posexplode(spoken).alias("k", "u")).select("doc_id", "body", "k", "u.pos", normalise(F.col("u.unit")).alias("unit"))
    words = F.length("unit") - F.length(F.replace("unit", F.lit(" "))) + 1
    units = store.cut(units.select("doc_id", "body", "k", "pos", words.alias("words"), F.unhex(F.md5("unit")).alias("digest")))
    place = F.struct("doc_id", "body", "k")
    again = units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    later = units.join(store.cut(again), "digest").filter(place > F.col("first")).select("doc_id", "body", "k", "pos", "words").distinct()
    own = Window.partitionBy("doc_id", "body")
    later = later.withColumn("run", F.col("k") - F.row_number().over(own.orderBy("k")))
    return later.withColumn("total", F.sum("words").over(Window.partitionBy("doc_id", "body", "run"))).select("doc_id", "body", "pos", (F.col("total") >= run_words).alias("gone"))


def deduplicate(docs: DataFrame, unit: str = "line", run_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_units, n_later, n_removed, removed_spans, kept_text), one row per row of docs with an id.

    Units are lines, paragraphs (ended by an empty line) or sentences of lines (ended by one of . ! ?
    and a space or tab, or by the line's end); unit names the kind. Of units with the same normal form all
    but the earliest are later ones. Runs of later units go if they have `run_words` words: 1
    removes every later unit. n_units counts the units with a word, n_later the later ones, removed or not. removed_spans are the removed
    units' places in the original text, "start-end" in characters, each with the separator that ends it,
    joined by commas; kept_text is what is left, in place.
    Null and empty texts have no units. Rows that repeat an id and text are the same document and get the
    same result; several texts under one id are ranked by a hash. Rows with a null id are left out. Other
    columns of docs don't matter. No task gets more than a text's units, nor all occurrences of a unit.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    repeats = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    rows = rows.select("doc_id", (F.xxhash64("text") if repeats else F.lit(0).cast("long")).alias("body"), "text")
    key = ["doc_id", "body"]
    later = store.cut(later_units(rows, unit, run_words))
    n_later = store.side(store.cut(later.groupBy(*key).agg(F.count("*").alias("n_later"))))
    gone = later.filter("gone").select(*key, "pos")
    parted = F.split("text", PARTED[unit])
    names = store.side(store.cut(gone.select(*key).distinct()))
    pieces = rows.join(names, key).groupBy(*key).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    pieces = pieces.select(*key, "copies", F.posexplode(parted).alias("pos", "piece")).join(gone.withColumn("gone", F.lit(True)), [*key, "pos"], "left")
    before = F.sum(F.length("piece")).over(Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.select(*key, "copies", F.struct("pos", before.alias("end"), "piece", F.coalesce("gone", F.lit(False)).alias("gone")).alias("p"))
    whole = pieces.groupBy(*key).agg(F.first("copies").alias("copies"), F.sort_array(F.collect_list("p")).alias("ps"))
    out, left = F.filter("ps", lambda p: p["gone"]), F.filter("ps", lambda p: ~p["gone"])
    spans = F.transform(out, lambda p: F.concat((p["end"] - F.length(p["piece"])).cast("string"), F.lit("-"), p["end"].cast("string")))
    n_units = lambda pieces, piece=lambda x: x: F.size(F.filter(pieces, lambda x: piece(x).rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    touched = whole.select(*key, n_units("ps", lambda p: p["piece"]).alias("n_units"), F.size(out).cast("long").alias("n_removed"), F.array_join(spans, ",").alias("removed_spans"), F.array_join(left["piece"], "").alias("kept_text"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")
    rest = rows.join(names, key, "left_anti")
    out = touched.union(rest.select(*key, n_units(parted), F.lit(0).cast("long"), F.lit(""), "text")).join(n_later, key, "left")
    return out.select("doc_id", "n_units", F.coalesce("n_later", F.lit(0).cast("long")).alias("n_later"), "n_removed", "removed_spans", "kept_text")


def digest(result: DataFrame) -> DataFrame:
    """The registered query's columns: the kept text as its MD5."""
    return result.select("doc_id", "n_units", "n_later", "n_removed", "removed_spans", F.md5("kept_text").alias("kept_md5"))


#: DuckDB SQL for the registered query.
ORACLE_SQL = rf"""
WITH s AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?][\x20\x09]|\x0A)', '\1' || chr(30), 'g'), chr(30)) AS us
  FROM documents WHERE doc_id IS NOT NULL
), u AS (
  SELECT doc_id, unnest(us) AS unit, unnest(range(len(us))) AS pos FROM s
), o AS (
  SELECT *, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS stop,
    trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM u
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS later
  FROM o WHERE norm <> ''
), r AS (
  SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM f WHERE later
), g AS (
  SELECT doc_id, pos, sum(length(norm) - length(replace(norm, ' ', '')) + 1) OVER (PARTITION BY doc_id, run) >= {RUN_WORDS} AS gone FROM r
)
SELECT o.doc_id, count(*) FILTER (WHERE norm <> '')::BIGINT AS n_units, count(g.pos)::BIGINT AS n_later, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  coalesce(string_agg((stop - length(unit)) || '-' || stop, ',' ORDER BY o.pos) FILTER (WHERE gone), '') AS removed_spans,
  md5(coalesce(string_agg(unit, '' ORDER BY o.pos) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_md5
FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.pos = g.pos GROUP BY o.doc_id
"""
