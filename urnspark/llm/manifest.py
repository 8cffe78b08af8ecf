"""A Merkle manifest of a table's rows, by group: nested leaf-rank intervals, containment joins, proofs (operator 12)."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urnspark.llm.shared import drop, read, stage

#: Children of a node are 2 to the power BITS.
BITS = 4
STEP = "struct<left: string, right: string>"
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """How a value enters a leaf: `-` if null, else its UTF-8 bytes' count, a colon and itself."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, come to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def proof(path: Column) -> Column:
    """The siblings of a path, from leaf to root and left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


@dataclass(frozen=True)
class Ranked:
    """leaves: tree, width, at, lo, hi, h and what was carried. trees: tree, ordinal, lo, hi, in order of groups. groups: their number."""

    leaves: DataFrame
    trees: DataFrame
    groups: int


def ranked(leaves: DataFrame, group: str, order: list[str], hash_col: str = "leaf") -> Ranked:
    """Each leaf with the interval [lo, hi) of its own rank in the table's order of group (null first), order and hash.

    tree is the least rank of the leaf's group, width the group's leaves, at the leaf's place there. Rows are
    range-sorted, so a group of any share of the rows is spread over parts, and only a row per part and group is summed.
    """
    spark = leaves.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [group, *[c for c in order if c != group], hash_col]
    dealt = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    row = F.monotonically_increasing_id()
    sorted_ = stage(dealt.withColumn("_part", F.shiftright(row, 33).cast("int")).withColumn("_pos", row.bitwiseAND((1 << 33) - 1)), "ranked-leaves")
    cells = sorted_.groupBy("_part", F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    every = Window.partitionBy("_group").orderBy("_part")  # a row per part at most
    cells = cells.withColumn("_new", (F.row_number().over(every) == 1).cast("long")).withColumn("width", F.sum("_n").over(Window.partitionBy("_group")))
    cells = stage(cells, "cells")
    sums = cells.groupBy("_part").agg(F.sum("_n").alias("_rows"), F.sum("_new").alias("_starts"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    base = sums.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_starts").over(before), F.lit(0)).alias("_ordinals"))
    # In a part the groups stand in order; the first may have begun in an earlier one.
    within = F.sum("_new").over(Window.partitionBy("_part").orderBy("_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    placed = cells.join(F.broadcast(base), "_part").withColumn("_ordinal", F.col("_ordinals") + within)
    starts = placed.where("_new = 1").select(F.col("_group").alias("_own"), (F.col("_base") + F.col("_first")).alias("tree"), F.col("_ordinal").alias("ordinal"), "width")
    starts = stage(starts, "trees")
    where = placed.select(F.col("_part").alias("_p"), "_group", "_base").join(starts, F.col("_group").eqNullSafe(F.col("_own"))).select("_p", "_group", "_base", "tree", "width")
    both = sorted_.join(where, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    lo = F.col("_base") + F.col("_pos")
    carried = [F.col(c) for c in leaves.columns if c != hash_col]
    out = both.select("tree", "width", (lo - F.col("tree")).alias("at"), lo.alias("lo"), (lo + 1).alias("hi"), F.col(hash_col).alias("h"), F.struct(*carried).alias("row"))
    return Ranked(out, starts.select("tree", "ordinal", F.col("tree").alias("lo"), (F.col("tree") + F.col("width")).alias("hi")), starts.count())


def runs(nodes: DataFrame, level: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Parents of a level's nodes: tree, width, at, lo, hi, h, kids. A node that is alone in its tree stands for itself.

    A parent's interval is what its kids cover; it takes the nodes whose place, less its last bits, is its own.
    """
    last = nodes.withColumn("at", F.shiftright("at", BITS))
    kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "h", *carry)))
    out = last.groupBy("tree", "width", "at").agg(kids.alias("kids"))
    h = F.when(F.col("width") > 1 << BITS * (level - 1), digest(F.array_join(F.transform("kids", lambda k: k["h"]), ""))).otherwise(F.col("kids")[0]["h"])
    return out.select("tree", "width", "at", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), h.alias("h"), "kids")


def climb(nodes: DataFrame, level: int, widest: int, carry: tuple[str, ...] = ()) -> list[DataFrame]:
    """The levels above nodes, each staged, until the widest tree has one node; a tree that is done doesn't go on."""
    out = []
    while True:
        nodes = stage(runs(nodes, level, carry), f"level-{level}")
        carry = ()
        out.append(nodes)
        if widest <= 1 << BITS * level:
            return out
        nodes = nodes.where(F.col("width") > 1 << BITS * level).select("tree", "width", "at", "lo", "hi", "h")
        level += 1


def step(kids: Column, lo: Column, hi: Column) -> Column:
    """What a parent's interval holds besides [lo, hi): the hashes of the nodes on its left and on its right."""
    some = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda k: k["h"]), "")
    return F.struct(some(lambda k: k["hi"] <= lo).alias("left"), some(lambda k: k["lo"] >= hi).alias("right"))


def attach(level: DataFrame, above: DataFrame) -> DataFrame:
    """A level's nodes with the path of the parent whose interval holds theirs, the step to it in front.

    above: tree, at, lo, hi, kids, path. Containment is looked for in one bucket a level: the parent's tree and place.
    """
    p = above.select(F.col("tree").alias("p_tree"), F.col("at").alias("p_at"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"), F.col("path").alias("p_path"))
    inside = (F.col("tree") == F.col("p_tree")) & (F.shiftright("at", BITS) == F.col("p_at")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
    alone = F.size("p_kids") == 1
    whole = (F.col("p_lo") == F.col("lo")) & (F.col("p_hi") == F.col("hi")) & (F.col("width") == 1)
    path = F.when(alone & whole, F.col("p_path")).otherwise(F.concat(F.array(step(F.col("p_kids"), F.col("lo"), F.col("hi"))), F.col("p_path")))
    return level.join(p, inside).select(*level.columns, path.alias("path"))


def prove(leaves: DataFrame, *, group: str, order: list[str], hash_col: str = "leaf") -> DataFrame:
    """All columns of leaves, and subroot, root, path (array of left, right: siblings' hashes joined) of each.

    In a group the leaves stand by order, then by hash, nulls first; while a tree has several nodes, every sixteen
    consecutive ones become their hash, also a last run of one. Subroots stand by group, null first, and form the top
    tree. Rows that repeat an id are leaves each; a group of one leaf has that leaf as its subroot, and one group's
    subroot is the root. An empty table gives no row. Extra columns may come along.

    Level by level from above, a node's path is the step to its parent and the parent's path, so a level costs its own
    nodes; a leaf gets its path from its run's row. No task sees more than sixteen children of a node.
    """
    made = ranked(leaves, group, order, hash_col)
    widest = made.leaves.agg(F.max("width")).first()[0]
    if widest is None:
        none = made.leaves.select("row.*", F.col("h").alias(hash_col), F.col("h").alias("subroot"), F.col("h").alias("root"))
        return none.withColumn("path", F.array().cast(f"array<{STEP}>"))
    bottom = climb(made.leaves, 1, widest, ("row",))
    tops = bottom[0].where(F.col("width") <= 1 << BITS)
    for k, level in enumerate(bottom[1:], 2):
        tops = tops.unionByName(level.where((F.col("width") <= 1 << BITS * k) & (F.col("width") > 1 << BITS * (k - 1))).withColumn("kids", F.lit(None).cast(bottom[0].schema["kids"].dataType)))
    tops = tops.select("tree", F.col("h").alias("subroot"))
    # The top tree: its nodes' intervals are those of whole groups.
    subroots = stage(made.trees.join(tops, "tree").select(F.lit(-1).cast("long").alias("tree"), F.lit(made.groups).cast("long").alias("width"), F.col("ordinal").alias("at"), "lo", "hi", F.col("subroot").alias("h"), F.col("tree").alias("own")), "subroots")
    above, staged = climb(subroots, 1, made.groups), []
    root = above[-1].select(F.col("h").alias("root"))
    now = above[-1].withColumn("path", F.array().cast(f"array<{STEP}>"))
    for level in reversed(above[:-1]):
        now = attach(level, now)
    groups = stage(attach(subroots, now).select(F.col("own").alias("g_tree"), F.col("h").alias("subroot"), F.col("path").alias("g_path")).crossJoin(F.broadcast(root)), "group-paths")  # root: one row
    now = None
    for k in range(len(bottom), 0, -1):
        level = bottom[k - 1]
        top = F.col("width") <= 1 << BITS * k
        ends = level.where(top).join(groups, F.col("tree") == F.col("g_tree")).select(*level.columns, F.col("g_path").alias("path"))
        now = stage(ends.unionByName(attach(level.where(~top), now)) if now is not None else ends, f"paths-{k}")
        staged.append(now)
    each = now.select("tree", "width", "kids", F.posexplode("kids").alias("_i", "kid"), "path")
    own = F.when(F.col("width") == 1, F.col("path")).otherwise(F.concat(F.array(step(F.col("kids"), F.col("kid")["lo"], F.col("kid")["hi"])), F.col("path")))
    each = each.select("tree", F.col("kid")["row"].alias("row"), F.col("kid")["h"].alias(hash_col), own.alias("path"))
    ends = groups.select("g_tree", "subroot", "root")
    out = each.join(ends, F.col("tree") == F.col("g_tree")).select("row.*", hash_col, "subroot", "root", "path")
    drop(*bottom, *above, subroots, *staged[:-1])
    return out


def leaf_of(text: Column, columns: tuple[str, ...] = LEAF) -> Column:
    """A document's leaf, with another text."""
    return digest(*[field(text if c == "text" else F.col(c)) for c in columns])


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def op12_nested_manifest(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    leaves = docs.select("doc_id", "source", leaf_of(F.col("text")).alias("leaf"), F.when(tampered, leaf_of(lowered(F.col("text")))).alias("bad"))
    out = prove(leaves, group="source", order=["doc_id"])
    folded = fold(F.coalesce("bad", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(text if c == "text" else c) for c in LEAF) + ")"
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
)
_TREE = lambda name, first, key: f"""{name} AS (
  {first}
  UNION ALL
  SELECT {key}, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), max((width + 15) // 16) FROM {name} WHERE width > 1 GROUP BY {key}, level, pos // 16
),
{name}_steps AS (
  SELECT a.{key}, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.{key} = b.{key} AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.width > 1 GROUP BY a.{key}, a.level, a.pos
)"""  # noqa: E731

#: The definition level by level, with sources by number: null is the first.
ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {_LEAF("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad
  FROM documents
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY s) AS n FROM leaves
),
{_TREE("low", "SELECT s, 0 AS level, place AS pos, leaf AS h, n AS width FROM placed", "s")},
subroots AS (SELECT s, h AS subroot, count(*) OVER () AS n FROM low WHERE width = 1),
{_TREE("top", "SELECT 0 AS t, 0 AS level, s AS pos, subroot AS h, n AS width FROM subroots", "t")},
walk AS (
  SELECT doc_id, s, place, leaf, 0 AS level, place AS pos, '' AS proof, coalesce(bad, leaf) AS h FROM placed
  UNION ALL
  SELECT doc_id, w.s, place, leaf, w.level + 1, w.pos // 16, proof || l || r, sha256(l || w.h || r) FROM walk w JOIN low_steps p ON w.s = p.s AND w.level = p.level AND w.pos = p.pos
),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY s, place ORDER BY level DESC) = 1),
rise AS (
  SELECT doc_id, s, place, leaf, 0 AS level, s AS pos, proof, h FROM ends
  UNION ALL
  SELECT doc_id, s, place, leaf, w.level + 1, w.pos // 16, proof || l || r, sha256(l || w.h || r) FROM rise w JOIN top_steps p ON w.level = p.level AND w.pos = p.pos
),
done AS (SELECT * FROM rise QUALIFY row_number() OVER (PARTITION BY s, place ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d.h AS folded_root, d.h = root AS verified
FROM done d JOIN subroots USING (s) CROSS JOIN (SELECT h AS root FROM top WHERE width = 1)
"""

QUERIES = {"op12_nested_manifest": op12_nested_manifest}
ORACLE_SQL = {"op12_nested_manifest": ORACLE}
