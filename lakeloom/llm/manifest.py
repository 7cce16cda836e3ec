"""Merkle manifest of a table, and octopus multiproofs of its rows.

Every `lang` has a binary tree over its rows in the order of doc_id; a further tree over the languages' subroots gives
the root. Trees grow by blocks of 2^STEP nodes: a task makes all levels inside a block, and the blocks' roots are the
leaves of the next round, so the number of rounds is the height over STEP and no task ever holds more than a block.

Proofs are made by leaf partitions, the blocks of the lowest level. A partition computes the coordinates of all nodes
that its leaves' paths need and that it can't derive itself, once each; these are fetched by one join; then it derives
the interiors that its leaves share and expands every leaf's own proof from both. Nodes near the roots are asked for by
many partitions: their rows are repeated, so that a key of the join has at most ASKERS askers.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.keys import add_surrogate_key
from . import store

#: Levels that a block holds above its leaves.
STEP = 10
#: Partitions that ask for one copy of a node, at most.
ASKERS = 1 << 14
#: The tree over the languages' subroots; a language's tree is named "=" and the language, that of null "-".
TOP = "top"
NODES = "tree string, n long, level int, place long, digest string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: of every value its UTF-8 byte count, a colon and the value; a null is a dash."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def height(n: int) -> int:
    """Levels above n leaves: every two nodes in a row have a parent, a last one alone too, until one is left."""
    return (n - 1).bit_length()


def width(n: int, level: int) -> int:
    """Nodes that a tree of n leaves has at a level."""
    return -(-n >> level) if level else n


def missing(places: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The octopus: coordinates (level, place) of the nodes that the paths of these leaves need besides what they derive."""
    own, out = sorted(set(places)), []
    for level in range(height(n)):
        there, last = set(own), width(n, level) - 1
        out += [(level, p ^ 1) for p in own if p ^ 1 not in there and p ^ 1 <= last]
        own = sorted({p >> 1 for p in own})
    return out


def derived(nodes: dict[tuple[int, int], str], places: Iterable[int], n: int) -> dict[tuple[int, int], str]:
    """`nodes` (the leaves' digests and what `missing` names) with all nodes on the leaves' paths, each made once."""
    own = sorted(set(places))
    for level in range(height(n)):
        above = sorted({p >> 1 for p in own})
        for p in above:
            right = nodes.get((level, 2 * p + 1))
            nodes[level + 1, p] = digest(nodes[level, 2 * p], right) if right else digest(nodes[level, 2 * p])
        own = above
    return nodes


def path(nodes: dict[tuple[int, int], str], place: int, n: int) -> list[tuple[str, bool]]:
    """A leaf's siblings upwards, (digest, whether it stands on the left); a level without one has ("", False)."""
    return [(nodes.get((level, place >> level ^ 1), ""), bool(place >> level & 1)) for level in range(height(n))]


def folded(leaf: str, siblings: list[tuple[str, bool]]) -> str:
    """The root that a leaf and its siblings give."""
    for other, left in siblings:
        leaf = digest(other, leaf) if left else digest(leaf, other)
    return leaf


def _grow_block(table: pa.Table) -> pa.Table:
    """All levels above a block of nodes, up to STEP levels or the root of their tree."""
    tree, n, level = (table[c][0].as_py() for c in ("tree", "n", "level"))
    by_place = dict(zip(table["place"].to_pylist(), table["digest"].to_pylist()))
    rows = []
    for level in range(level + 1, min(level + STEP, height(n)) + 1):
        pairs = ((p, by_place[2 * p], by_place.get(2 * p + 1)) for p in sorted({p >> 1 for p in by_place}))
        by_place = {p: digest(a, b) if b else digest(a) for p, a, b in pairs}
        rows += [(level, p, h) for p, h in by_place.items()]
    levels, places, digests = zip(*rows) if rows else ((), (), ())
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    columns = ([tree] * len(rows), [n] * len(rows), levels, places, digests)
    return pa.table([pa.array(x, t) for x, t in zip(columns, types)], ["tree", "n", "level", "place", "digest"])


def grow(leaves: DataFrame) -> DataFrame:
    """All nodes (tree, n, level, place, digest) of the trees over leaves (tree, n, place, digest), the leaves included."""
    levels = height(leaves.agg(F.max("n")).first()[0] or 1)
    now = out = leaves.select("tree", "n", F.lit(0).alias("level"), "place", "digest")
    for level in range(0, levels, STEP):
        blocks = now.filter(F.col("n") > (1 << level)).groupBy("tree", F.shiftright("place", STEP))
        made = store.cut(blocks.applyInArrow(_grow_block, NODES))
        now, out = made.filter(F.col("level") == level + STEP), out.unionByName(made)
    return out


def build(docs: DataFrame, fields: list[str] = FIELDS, tree: str = "lang", key: str = "doc_id", also: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The manifest of a table: (leaves, nodes, trees).

    leaves: (tree, n, place, key, digest) and the columns of `also`; nodes: (tree, n, level, place, digest) of all trees
    from the leaves up; trees: (tree, n, subroot, top_place, top_n, root), a row for each tree of the table.

    Defined results: null keys come first in their tree, rows of one key stand in the order of their digests; null and
    empty values have different digests; a null `tree` value has a tree of its own, before all others; an empty
    table has no tree and no root; other columns don't count; texts are digested whole.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-"))
    rows = docs.select(F.col(tree).alias("_tree"), F.col(key).alias("key"), name.alias("tree"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *(c.alias(n) for n, c in (also or {}).items()))
    rows = store.cut(add_surrogate_key(rows, "_all", ["_tree", "key", "digest"], -1))
    spans = store.cut(rows.groupBy("tree", "_tree").agg(F.min("_all").alias("_first"), F.count("*").alias("n")))
    leaves = rows.join(store.side(spans.select("tree", "_first", "n")), "tree").withColumn("place", F.col("_all") - F.col("_first")).drop("_all", "_first", "_tree")
    leaves = store.cut(leaves)
    nodes = grow(leaves)
    roots = nodes.filter("place = 0 AND shiftleft(1L, level) >= n")
    roots = roots.join(store.side(spans.select("tree", "_tree")), "tree").select("tree", "_tree", "n", F.col("digest").alias("subroot"))
    roots = store.cut(add_surrogate_key(roots, "top_place", ["_tree"], -1))
    top_n = roots.count()
    above = grow(roots.select(F.lit(TOP).alias("tree"), F.lit(top_n).cast("long").alias("n"), F.col("top_place").alias("place"), F.col("subroot").alias("digest")))
    root = above.filter((F.col("place") == 0) & (F.col("level") == height(max(top_n, 1)))).first()
    trees = roots.select("tree", "n", "subroot", "top_place", F.lit(top_n).cast("long").alias("top_n"), F.lit(root and root["digest"]).cast("string").alias("root"))
    return leaves, nodes.unionByName(above), trees


def _ask(table: pa.Table) -> pa.Table:
    """Coordinates that a leaf partition has to fetch, of its own tree and of the one above."""
    tree, part, n, at, top_n = (table[c][0].as_py() for c in ("tree", "part", "n", "top_place", "top_n"))
    asked = [(tree, *x) for x in missing(table["place"].to_pylist(), n)] + [(TOP, *x) for x in missing([at], top_n)]
    columns = list(zip(*asked)) or [[]] * 3
    names, types = ["part_tree", "part", "tree", "level", "place"], [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
    return pa.table([pa.array(x, t) for x, t in zip(([tree] * len(asked), [part] * len(asked), *columns), types)], names)


def _expand(key_type: pa.DataType):
    def expand(asked: pa.Table, fetched: pa.Table) -> pa.Table:
        """Every leaf's proof and what its claim folds to, from the partition's own leaves and what it fetched."""
        tree, n, at, top_n = (asked[c][0].as_py() for c in ("tree", "n", "top_place", "top_n"))
        own, top = {}, {}
        for t, level, p, h in zip(*(fetched[c].to_pylist() for c in ("tree", "level", "place", "held"))):
            (top if t == TOP else own)[level, p] = h
        places, leaves, claims = (asked[c].to_pylist() for c in ("place", "digest", "claim"))
        own |= {(0, p): h for p, h in zip(places, leaves)}
        derived(own, places, n)
        subroot = own[height(n), 0]
        top[0, at] = subroot
        derived(top, [at], top_n)
        root, upper = top[height(top_n), 0], path(top, at, top_n)
        proofs, found = [], []
        for p, leaf, claim in zip(places, leaves, claims):
            siblings = path(own, p, n) + upper
            proofs.append(digest(*(h for h, _ in siblings)))
            found.append(root if claim == leaf else folded(claim, siblings))  # the partition's own interiors are an honest leaf's fold
        columns = [asked["key"].cast(key_type), pa.array([tree] * len(places), pa.string()), asked["digest"], pa.array(proofs, pa.string()), pa.array(found, pa.string())]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["key", "tree", "leaf", "proof", "folded_root"])

    return expand


def prove(leaves: DataFrame, nodes: DataFrame, trees: DataFrame, claim: str = "claim") -> DataFrame:
    """(key, tree, leaf, proof, folded_root) of the given leaves, some or all of a manifest's.

    proof is the digest of a leaf's siblings from its level up to the root, folded_root what its claim (a digest, the
    leaf's own if null) gives with them. A leaf is verified where that is the root.
    """
    part = F.shiftright("place", STEP).alias("part")
    asked = leaves.select("key", "tree", "n", "place", "digest", F.coalesce(claim, "digest").alias("claim"), part)
    asked = asked.join(store.side(trees.select("tree", "top_place", "top_n")), "tree")
    wanted = asked.select("tree", "part", "n", "place", "top_place", "top_n").groupBy("tree", "part")
    wanted = store.cut(wanted.applyInArrow(_ask, "part_tree string, part long, tree string, level int, place long"))
    node = ["tree", "level", "place"]
    copies = F.ceil(F.count("*") / ASKERS).cast("long")
    many = store.cut(wanted.groupBy(*node).agg(copies.alias("copies")).filter("copies > 1"))
    copies, low = F.coalesce("copies", F.lit(1).cast("long")), wanted.agg(F.min("level")).first()[0] or 0
    wanted = wanted.join(store.side(many), node, "left").withColumn("copy", F.pmod(F.xxhash64("part_tree", "part"), copies)).drop("copies")
    held = nodes.filter(F.col("level") >= low).select(*node, F.col("digest").alias("held")).join(store.side(many), node, "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies")
    fetched = wanted.join(held, [*node, "copy"]).drop("copy")
    kind = leaves.schema["key"].dataType
    schema = f"key {kind.simpleString()}, tree string, leaf string, proof string, folded_root string"
    return asked.groupBy("tree", "part").cogroup(fetched.groupBy("part_tree", "part")).applyInArrow(_expand(to_arrow_type(kind)), schema)


def _piece(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _leaf_sql(**changed: str) -> str:
    return "sha256(" + " || ".join(_piece(changed.get(c, c)) for c in FIELDS) + ")"


_GROWN = "SELECT tree, level + 1, place // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) FROM (SELECT *, lead(h) OVER (PARTITION BY tree ORDER BY place) AS other FROM {0} WHERE n > 1) WHERE place % 2 = 0"
ORACLE_SQL = f"""WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS crc),
  sums AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c // 256, crc[1 + xor(c % 256, x)]))) AS id_crc FROM documents, steps),
  leaves AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, lang, {_leaf_sql()} AS leaf, CASE WHEN id_crc % 7 = 0 THEN {_leaf_sql(n_chars="(n_chars + 1)")} ELSE {_leaf_sql()} END AS claim FROM sums),
  placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
  below(tree, level, place, n, h) AS (SELECT tree, 0, place, n, leaf FROM placed UNION ALL {_GROWN.format("below")}),
  subroots AS (SELECT b.tree, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_place, count(*) OVER () AS n FROM below b JOIN (SELECT DISTINCT tree, lang FROM leaves) USING (tree) WHERE n = 1),
  above(tree, level, place, n, h) AS (SELECT 'top', 0, lang_place, n, subroot FROM subroots UNION ALL {_GROWN.format("above")}),
  paths AS (SELECT l.doc_id, l.leaf, l.claim, l.place AS of, l.tree, 0 AS stage, b.level, b.place % 2 AS odd, coalesce(s.h, '') AS other
    FROM placed l JOIN below b ON b.tree = l.tree AND b.place = l.place >> b.level AND b.n > 1 LEFT JOIN below s ON s.tree = b.tree AND s.level = b.level AND s.place = xor(b.place, 1)
    UNION ALL SELECT l.doc_id, l.leaf, l.claim, l.place, l.tree, 1, b.level, b.place % 2, coalesce(s.h, '')
    FROM placed l JOIN subroots r ON r.tree = l.tree JOIN above b ON b.place = r.lang_place >> b.level AND b.n > 1 LEFT JOIN above s ON s.level = b.level AND s.place = xor(b.place, 1)),
  proofs AS (SELECT tree, of, sha256(string_agg(other, '' ORDER BY stage, level)) AS proof_sha256, list_reduce(list_prepend(any_value(claim), list(odd || other ORDER BY stage, level)), lambda c, x: CASE WHEN x[1] = '1' THEN sha256(x[2:] || c) ELSE sha256(c || x[2:]) END) AS folded_root FROM paths GROUP BY ALL)
SELECT l.doc_id, l.leaf, r.subroot, a.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, coalesce(folded_root, l.claim) AS folded_root, coalesce(folded_root, l.claim) = a.h AS verified
FROM placed l JOIN subroots r USING (tree) JOIN above a ON a.n = 1 LEFT JOIN proofs p ON p.tree = l.tree AND p.of = l.place"""
