"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of keys are made from each document's set of word shingles, each key from
two minhashes. A table key is a pair (key of the first collection, key of the second), so m + m
keys stand for m * m tables and only 4 m minhashes are computed. Documents that share a table key
are candidates; candidates are verified on their full shingle sets.

Big buckets never yield all their pairs. All documents of a bucket are compared with one pivot, the
one with the smallest share of shingles that no other document has, and those that it rejects with a second
one, the nearest of them; most links show there, and copies cost one comparison each. A document x differs
from its pivot p by what it lost of p and what it has besides. Since
|x & y| = |p| - lost(x) - lost(y) + |diff(x) & diff(y)|, two documents that no pivot links are linked only if their
differences share so many items. How many is bounded below for every two bins of distances from the pivot, and a
prefix filter over the rarest items of the differences, with a prefix for each bin that the other side may be in,
finds the candidates, which are verified on the full sets. So no link is lost within a bucket, save
between documents that a pivot connects already.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit

WORDS = 5
PERCENT = 75
#: Bytes of shingle hashes that one task counts at once, about.
BUCKET_BYTES = 24 << 20
#: Slots of the table of counts, up to 65,535, that orders items by rarity; 2 bytes each are broadcast.
SLOTS, SHIFT = 1 << 22, np.uint64(42)
#: Documents compared with one copy of their pivot's set; a larger bucket's pivot gets several copies.
SALT_ROWS = 256
#: Bins of the distance from a pivot, in parts of the pivot's size; the last is open. More bins give more rows and shorter prefixes.
BINS, MOST_BINS = 16, 64
#: Keys in each of the two collections: at similarity 0.75 a linked pair shares no table with
#: probability 2 * (1 - 0.75 ** 2) ** 14 = 2e-5, at 0.85 with 2e-8.
KEYS = 14
_SEEDS = np.random.default_rng(7).integers(1, 2**63, 4 * 64, dtype=np.uint64) | np.uint64(1)


def signatures(docs: DataFrame, k: int = WORDS, keys: int = KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, band: array of 2 * keys longs).

    set_a and set_b are two 64-bit hashes of the whole set. band has the first collection's keys, then
    the second's; it is empty for a document without words.
    """

    @textkit.released
    def run(batches):
        for batch, buf, off in textkit.parts(batches):
            n = len(batch)
            doc, w = textkit.shingle_sets(buf, off, k)
            count = np.bincount(doc, minlength=n)
            have = np.flatnonzero(count)
            at = np.concatenate([[0], np.cumsum(count)])[:-1][have]
            sums = [np.zeros(n, np.uint64) for _ in range(2)]
            band = np.zeros((len(have), 2 * keys), np.uint64)
            if len(have):
                for j, s in enumerate(sums):
                    s[have] = np.add.reduceat(textkit.mix(w + np.uint64(j + 1)), at)
                for j in range(4 * keys):
                    least = np.minimum.reduceat((w ^ (w >> np.uint64(29))) * _SEEDS[j] ^ (_SEEDS[j] >> np.uint64(7)), at)
                    band[:, j // 2] = textkit.mix(band[:, j // 2] * np.uint64(31) + least + np.uint64(j // 2 + 1))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((count > 0) * 2 * keys)]).astype(np.int32)), pa.array(band.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(count.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists], ["doc_id", "n_shingles", "set_a", "set_b", "band"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, band array<long>")


def sets(docs: DataFrame, k: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, set_a, items): each text's distinct shingles as sorted 64-bit hashes in one binary cell, and the hash of the set."""

    @textkit.released
    def run(batches):
        for batch, buf, off in textkit.parts(batches):
            doc, w = textkit.shingle_sets(buf, off, k)
            count = np.bincount(doc, minlength=len(batch))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textkit.mix(w + np.uint64(1)))])
            at = np.cumsum(count)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array((total[at] - total[at - count]).view(np.int64)), textkit.to_binary(w, count)], ["doc_id", "set_a", "items"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, set_a long, items binary")


def table_keys(signed: DataFrame, keys: int = KEYS) -> DataFrame:
    """(key, doc): the tables' buckets with two documents or more.

    Collection keys that only one document has are dropped before pairs are formed: no bucket
    made with them could hold another document.
    """
    half = signed.select("doc_id", F.posexplode("band").alias("slot", "part"))
    half = store.cut(half)
    shared = half.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part")
    kept = half.join(shared, "part").groupBy("doc_id").agg(F.collect_list(F.struct("slot", "part")).alias("parts"))
    side = lambda cond: F.filter("parts", lambda x: cond(x["slot"]))
    pairs = kept.select("doc_id", F.explode(side(lambda s: s < keys)["part"]).alias("x"), side(lambda s: s >= keys)["part"].alias("ys")).select("doc_id", "x", F.explode("ys").alias("y"))
    rows = store.cut(pairs.select(F.xxhash64("x", "y").alias("key"), F.col("doc_id").alias("doc")))
    several = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return rows.join(several, "key")


def alone(items: DataFrame, buckets: int) -> DataFrame:
    """(doc, alone): how many of a document's shingles no other document of `items` has.

    Shingles are dealt by their hash. A task sends each shingle once, with its document if the task
    knows no other, so a shingle that very many documents share takes a row per task at most.
    """

    @textkit.released
    def deal(batches):
        for batch in batches:
            cells = batch.column(1)
            count = np.array([len(c.as_buffer()) // 8 if c.is_valid else 0 for c in cells])
            h = np.concatenate([np.frombuffer(c.as_buffer(), np.uint64) for c in cells] or [np.zeros(0, np.uint64)])
            doc = np.repeat(batch.column(0).to_numpy(), count)
            h, first, n = np.unique(h, return_index=True, return_counts=True)
            doc, where = doc[first], (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            size = np.bincount(where, minlength=buckets)
            full = np.flatnonzero(size)
            cell = [textkit.to_binary(x[order], size[full]) for x in (h, doc, n > 1)]
            yield pa.RecordBatch.from_arrays([pa.array(full), *cell], ["bucket", "h", "doc", "several"])

    @textkit.released
    def count(table):
        h, doc, several = (np.concatenate([np.frombuffer(c.as_buffer(), t) for c in table.column(k)] or [np.zeros(0, t)]) for k, t in (("h", np.uint64), ("doc", np.int64), ("several", bool)))
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        who, times = np.unique(doc[(n[back] == 1) & ~several], return_counts=True)
        return pa.table({"doc": who, "alone": times})

    dealt = items.select("id", "items").mapInArrow(deal, "bucket long, h binary, doc binary, several binary")
    return dealt.groupBy("bucket").applyInArrow(count, "doc long, alone long").groupBy("doc").agg(F.sum("alone").alias("alone"))


def feasible(members: DataFrame, percent: int) -> DataFrame:
    """Members (key, doc, n, s) that some other member of the bucket can be similar to.

    s counts the shingles that any other document has, so two documents have at most min(s, s') in
    common. With that, x needs a partner of at most 100 s / percent + s - n shingles.
    """
    least = members.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("c"))
    room = 100 * F.col("s") / percent + F.col("s") - F.col("n")
    return members.join(least, "key").filter((F.col("c") > 1) & (F.col("least") <= room + 1e-6)).select("key", "doc", "n", "s")


def hot_pivots(pairs: DataFrame) -> DataFrame:
    """(b, salts) of every b that stands in many pairs: how many copies of its set share the work."""
    return pairs.groupBy("b").agg(F.count("*").alias("c")).filter(F.col("c") > SALT_ROWS).select("b", F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts"))


def with_sets(pairs: DataFrame, items: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Adds `ia` and `ib`, the sets of a and b, to rows (a, b, ...); hot: from hot_pivots."""
    out = pairs.join(items.select(F.col("id").alias("a"), F.col("items").alias("ia")), "a")
    of_b = items.select(F.col("id").alias("b"), F.col("items").alias("ib"))
    if hot is None:
        return out.join(of_b, "b")
    n = F.coalesce("salts", F.lit(1))
    out = out.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), n).cast("int")).drop("salts")
    of_b = of_b.join(hot, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
    return out.join(of_b, ["b", "salt"]).drop("salt")


def overlap(pairs: DataFrame, items: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Adds `common`, the number of items that the sets of a and b share, to rows (a, b, ...)."""
    names = pairs.columns

    @textkit.released
    def run(batches):
        for batch in batches:
            x, y = batch.column(len(names)), batch.column(len(names) + 1)
            out = np.zeros(len(batch), np.int64)
            for i in range(len(batch)):
                p, q = (np.frombuffer(z[i].as_buffer(), np.uint64) for z in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                if len(p):
                    out[i] = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(out)], [*names, "common"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", common long"
    return with_sets(pairs, items, hot).select(*names, "ia", "ib").mapInArrow(run, schema)


def differences(pairs: DataFrame, items: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds `diff` to rows (a, b, ...): the hashes that just one of the sets has, each named with b, in one binary cell."""
    names = pairs.columns

    @textkit.released
    def run(batches):
        for batch in batches:
            pivots = textkit.mix(batch.column(names.index("b")).to_numpy().astype(np.uint64))
            sides = zip(batch.column(len(names)), batch.column(len(names) + 1), pivots)
            cells = [textkit.mix(np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True) ^ p).tobytes() for x, y, p in sides]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(cells, pa.binary())], [*names, "diff"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", diff binary"
    return with_sets(pairs, items, hot).select(*names, "ia", "ib").mapInArrow(run, schema)


def slot_counts(table: DataFrame, cell: str) -> np.ndarray:
    """How often the hashes in a binary column fall into each of SLOTS slots; of a fixed size at the driver."""

    @textkit.released
    def tally(batches):
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            h = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            slot, n = np.unique(h >> SHIFT, return_counts=True)
            total[slot.astype(np.int64)] += n.astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(16)), pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in total.reshape(16, -1)], pa.binary())], ["part", "cell"])

    def add(group):
        return pa.table({"part": group.column("part")[:1], "cell": pa.array([np.minimum(sum(np.frombuffer(pa.decompress(c.as_py(), SLOTS // 4, codec="zstd", asbytes=True), np.uint32) for c in group.column("cell")), 65535).astype(np.uint16).tobytes()], pa.binary())})

    out = np.zeros((16, SLOTS // 16), np.uint16)
    for r in table.select(cell).mapInArrow(tally, "part long, cell binary").groupBy("part").applyInArrow(add, "part long, cell binary").collect():
        out[r["part"]] = np.frombuffer(r["cell"], np.uint16)
    return out.ravel()


def rare_differences(rows: DataFrame) -> DataFrame:
    """(key, doc, n, far, d, nb, side) from rows (a, na, nb, far, d, bin, bins, diff).

    bins: (bin, least far, most d) of all documents around the pivot. For each bin that the other
    document may be in, the key names an item of a's difference that can be the rarest of those shared,
    together with the two bins; side tells which of the two is a's: 0 the first, 1 the second, 2 both.
    An item that is alone in its slot is in no other row, and left out.
    """
    count = rows.sparkSession.sparkContext.broadcast(slot_counts(rows, "diff"))

    @textkit.released
    def run(batches):
        for batch in batches:
            for a, n, nb, far, d, own, bins, cell in zip(*(c.to_pylist() for c in batch.columns)):
                h = np.frombuffer(cell, np.uint64)
                times = count.value[(h >> SHIFT).astype(np.int64)]
                order = np.lexsort((h, times))
                h, first = h[order], int((times <= 1).sum())
                keys, sides = [], []
                for b in bins:
                    if own // MOST_BINS == b["bin"] // MOST_BINS != OPEN:
                        continue  # connected by a pivot
                    need = max(1, int(np.ceil(far + b["least"] - nb - 1e-6)))
                    if need > min(d, b["most"]) or d - need + 1 <= first:
                        continue
                    lo, hi = sorted((own, b["bin"]))
                    keys.append(textkit.mix(h[first : d - need + 1] + np.uint64(lo * 1021 + hi)))
                    sides.append(np.full(len(keys[-1]), 2 if lo == hi else int(own == hi)))
                if keys:
                    key = np.concatenate(keys)
                    full = (np.full(len(key), x) for x in (a, n, far, d, nb))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *map(pa.array, full), pa.array(np.concatenate(sides))], ["key", "doc", "n", "far", "d", "nb", "side"])

    return rows.select("a", "na", "nb", "far", "d", "bin", "bins", "diff").mapInArrow(run, "key long, doc long, n long, far double, d long, nb long, side long")


#: What a document is to the pivots of its bucket: linked with the first, with the second, or with neither.
FIRST, SECOND, OPEN = 0, 1, 2


def bucket_links(members: DataFrame, sizes: DataFrame, items_of: Callable[[DataFrame], DataFrame], percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect whatever similar documents share a bucket.

    members: (key, doc); sizes: (doc, n), the set sizes; items_of(ids) gives (id, items).
    The links need not list every similar pair, but join the same documents to components.
    """
    items = store.cut(items_of(store.cut(members.select(F.col("doc").alias("id")).distinct())))
    total = items.agg(F.sum(F.length("items"))).first()[0] or 0
    shared = sizes.join(alone(items, max(1, total // BUCKET_BYTES)), "doc", "left").select("doc", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("s"))
    members = store.cut(feasible(members.join(shared, "doc"), percent))
    pivots = members.groupBy("key").agg(F.min_by(F.struct("doc", "n"), F.struct(-F.col("s") / F.col("n"), "doc")).alias("p"))
    star = members.join(pivots, "key").filter("doc <> p.doc").select(F.col("doc").alias("a"), F.col("p.doc").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb"))
    star = store.cut(star.distinct())
    similar = 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))

    hot = store.side(store.cut(hot_pivots(star)))
    far = F.col("nb") - F.col("common") + percent * F.col("na") / (100 + percent)
    seen = overlap(star, items, hot).withColumns({"linked": similar, "far": far, "d": F.col("na") + F.col("nb") - 2 * F.col("common")})
    seen = store.cut(seen.drop("common"))
    rejected = seen.filter(~F.col("linked"))
    # a second pivot for those that the first rejects: the nearest of them
    nearest = rejected.groupBy("b").agg(F.min_by(F.struct("a", "na"), F.struct("far", "a")).alias("q"), F.count("*").alias("c")).filter("c > 1")
    asked = rejected.join(nearest, "b").filter("a <> q.a").select("a", F.col("q.a").alias("b"), "na", F.col("q.na").alias("nb"), F.col("b").alias("pivot"))
    asked = store.cut(asked)
    second = store.cut(overlap(asked, items, store.side(store.cut(hot_pivots(asked)))).filter(similar).select("a", "b", "pivot"))

    # what is left: documents that no pivot connects, and their bins of distances
    reached = second.select("a", F.col("pivot").alias("b")).union(second.select(F.col("b").alias("a"), F.col("pivot").alias("b"))).distinct().withColumn("second", F.lit(True))
    kind = F.when(F.col("linked"), FIRST).when(F.col("second"), SECOND).otherwise(OPEN)
    bin_ = F.least(F.floor(BINS * F.col("far") / F.col("nb")), F.lit(MOST_BINS - 1)).cast("int")
    rows = store.cut(seen.join(reached, ["a", "b"], "left").select("a", "b", "na", "nb", "far", "d", (kind * MOST_BINS + bin_).alias("bin")))
    bins = rows.groupBy("b", "bin").agg(F.min("far").alias("least"), F.max("d").alias("most"), F.count("*").alias("c"))
    bins = bins.groupBy("b").agg(F.collect_list(F.struct("bin", "least", "most")).alias("bins"), F.sum("c").alias("c"), F.max("bin").alias("last"))
    bins = bins.filter((F.col("c") > 1) & (F.col("last") >= SECOND * MOST_BINS)).select("b", "bins")
    rare = store.cut(rare_differences(store.cut(differences(rows.join(bins, "b"), items, hot))))
    of = lambda c: [F.col(x).alias(f"{x}_{c}") for x in ("doc", "n", "far", "d")]
    maybe = rare.filter("side <> 1").select("key", "side", "nb", *of(1)).join(rare.filter("side <> 0").select("key", *of(0)), "key")
    enough = (F.col("far_0") + F.col("far_1") - F.col("nb") <= F.least("d_0", "d_1") + 1e-6) & (100 * F.least("n_0", "n_1") >= percent * F.greatest("n_0", "n_1"))
    maybe = maybe.filter(enough & (F.col("doc_0") != F.col("doc_1")) & ((F.col("side") != 2) | (F.col("doc_0") > F.col("doc_1"))))
    maybe = maybe.select(F.col("doc_1").alias("a"), F.col("doc_0").alias("b"), F.col("n_1").alias("na"), F.col("n_0").alias("nb")).distinct()
    across = overlap(maybe, items).filter(similar).select("a", "b")
    return store.cut(seen.filter("linked").select("a", "b").union(second.select("a", "b")).union(across))


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, keys: int = KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row with an id.

    Documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of k-word shingles;
    component_id is the smallest id reachable over links, and kept marks the rows that have it as their id.
    Null and empty texts have an empty set and are linked with nothing. Rows with a null id are left
    out, for they can't be named in a link. Rows that repeat an id are each told by their own text, so
    rows of one id with different texts may be in different components. Very long texts are one set each,
    and other columns don't matter; an empty table gives no rows. Equal sets are collapsed first, by two 64-bit hashes and the size, so
    copies cost no comparison.
    """
    docs = store.small_batches(docs).filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = store.cut(signatures(docs, k, keys))
    same = ["n_shingles", "set_a", "set_b"]
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("band").alias("band"))
    classes = store.cut(classes.withColumn("class", F.monotonically_increasing_id()))

    def items_of(ids: DataFrame) -> DataFrame:
        wanted = store.cut(store.semi(classes.select(F.col("class").alias("id"), F.col("rep").alias("doc_id"), "set_a"), ids, "id"))
        found = sets(store.semi(docs, wanted.select("doc_id"), "doc_id"), k).dropDuplicates(["doc_id", "set_a"])
        return found.join(wanted, ["doc_id", "set_a"]).select("id", "items")

    sizes = classes.select(F.col("class").alias("doc"), F.col("n_shingles").alias("n"))
    links = bucket_links(table_keys(classes.select(F.col("class").alias("doc_id"), "band"), keys), sizes, items_of, percent)
    named = classes.join(store.components(links).withColumnRenamed("id", "class"), "class", "left").select(*same, "rep", "component")
    least = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = store.cut(named.join(least, "component", "left").select(*same, F.coalesce("least", "rep").alias("component_id")))
    out = signed.select("doc_id", *same).join(named, same, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


#: DuckDB SQL for the registered query: every pair that shares a shingle, and all ids reachable over links.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM p
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT id, b FROM r JOIN e ON other = a
), m AS (
  SELECT id, min(other) AS component_id FROM r GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON doc_id = id
"""
