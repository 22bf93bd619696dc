"""Merkle manifest of a dataset: ternary trees of row digests per group, and one over the groups' roots.

Rows are digested where they are read; only digests are shuffled. A tree's nodes are numbered and dealt out in
aligned blocks of 3 ** LEVELS. A block keeps each of its levels as one string of hex digests, so that three
neighbours are a fixed-width substring: hashed, it is their parent, and what flanks a node in it are its siblings.
The blocks' tops are the nodes of the next round, until each tree has one; a second pass hands the siblings above
a block down to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..runtime import broadcast_if, materialize, ranked

ARITY, LEVELS = 3, 6
BLOCK = ARITY ** LEVELS
DIGEST = 64
# Upper siblings take up to some 2 kB a block: at most so many rows of them are broadcast.
PATH_ROWS = 20_000
# Rows of two numbers and a group's name, of which a partition has few.
OFFSET_ROWS = 200_000


# ---------------------------------------------------------------- leaves

def leaf(*values: Column) -> Column:
    """Digest of a row: each value as the number of its UTF-8 bytes, a colon and the value; null is a dash."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """A key without nulls, in the order of the groups: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """`nodes` with `at`, the place from 0 inside its `tree` under `order`, and `m`, the tree's size.

    Rows are range-partitioned on (tree, order), so a large tree is spread over many tasks; places are counted inside
    the sorted partitions and shifted by the rows of the tree in earlier ones.
    """
    spark, keys = nodes.sparkSession, ["tree", *order]
    parts = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(nodes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    runs = placed.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(runs.select(
        F.col("_part").alias("_p"), F.col("tree").alias("_t"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(tree).alias("m")))
    here = (F.col("_part") == F.col("_p")) & (F.col("tree") == F.col("_t"))
    joined = placed.join(broadcast_if(offsets, offsets.count(), OFFSET_ROWS), here)
    return joined.withColumn("at", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_t", "_shift")


# ---------------------------------------------------------------- levels of a block

def _parents(level: Column) -> Column:
    """The level above: digests of each three neighbours, as one string again."""
    width = ARITY * DIGEST
    runs = F.sequence(F.lit(0), F.ceil(F.length(level) / width).cast("int") - 1)
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "").cast("binary")


def _steps() -> Column:
    """Levels to climb: until a tree has one node, or to the top of a block."""
    return reduce(lambda above, k: F.when(F.col("m") <= ARITY ** k, k).otherwise(above), range(LEVELS - 1, -1, -1), F.lit(LEVELS))


def _siblings(i: Column) -> Column:
    """(left, right) of node `i` of the block, on each level below its top."""
    def flanks(k: Column) -> Column:
        below = F.element_at("levels", k)
        own = F.floor(i / F.pow(F.lit(float(ARITY)), k - 1)).cast("int")
        start, place = F.floor(own / ARITY).cast("int") * (ARITY * DIGEST) + 1, own % ARITY * DIGEST
        return F.struct(F.substring(below, start, place).cast("string").alias("left"),
                        F.substring(below, start + place + DIGEST, F.lit((ARITY - 1) * DIGEST) - place).cast("string").alias("right"))

    none = F.array().cast("array<struct<left:string,right:string>>")
    return F.when(F.size("levels") > 1, F.transform(F.sequence(F.lit(1), F.size("levels") - 1), flanks)).otherwise(none)


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, m, nodes, levels, top) of (tree, at, m, hash, ...): one row per aligned block."""
    extra = [c for c in nodes.columns if c not in ("tree", "m")]
    grouped = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("at", *[c for c in extra if c != "at"]))).alias("nodes"))
    leaves = grouped.withColumn("level", F.array_join("nodes.hash", "").cast("binary")).withColumn("steps", _steps())
    up = F.aggregate(F.when(F.col("steps") > 0, F.sequence(F.lit(1), F.col("steps"))).otherwise(F.array().cast("array<int>")),
                     F.array("level"), lambda levels, _: F.array_append(levels, _parents(F.element_at(levels, -1))))
    built = leaves.withColumn("levels", up).drop("level", "steps")
    return materialize(built.withColumn("top", F.element_at("levels", -1).cast("string")))


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks, lowest first, and (tree, top) of the finished trees."""
    rounds, finished = [], None
    while True:
        blocks = _blocks(nodes)
        rounds.append(blocks)
        done = blocks.where(F.col("m") <= BLOCK).select("tree", "top")
        finished = done if finished is None else finished.unionByName(done)
        if (blocks.agg(F.max("m")).first()[0] or 0) <= BLOCK:
            return rounds, finished
        nodes = blocks.where(F.col("m") > BLOCK).select(
            "tree", F.col("block").alias("at"), F.ceil(F.col("m") / BLOCK).alias("m"), F.col("top").alias("hash"))


def _above(blocks: DataFrame, upper: DataFrame) -> DataFrame:
    """`blocks` with `up`, the siblings above its top, and the roots that `upper` names per (_tree, _at).

    A finished tree's block takes the row of the tree above (`_last`), another the row of the round above.
    """
    here = (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_at")) & ((F.col("m") <= BLOCK) == F.col("_last"))
    return blocks.join(broadcast_if(upper, upper.count(), PATH_ROWS), here)


def _descend(rounds: list[DataFrame], crown: DataFrame) -> DataFrame:
    """The lowest blocks with `up`, `subroot` and `root`; `crown` has (_tree, _at = 0, up, subroot, root) of every tree."""
    crown = crown.withColumn("_last", F.lit(True))
    upper = crown
    for blocks in rounds[:0:-1]:
        held = _above(blocks, upper)
        inner = F.transform("nodes", lambda x: F.struct(x["at"].alias("_at"), F.concat(_siblings((x["at"] % BLOCK).cast("int")), F.col("up")).alias("up")))
        rows = held.select(F.col("tree").alias("_tree"), "subroot", "root", F.explode(inner).alias("_x"))
        upper = materialize(crown.unionByName(rows.select("_tree", "_x._at", "_x.up", "subroot", "root", F.lit(False).alias("_last"))))
    return _above(rounds[0], upper)


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Blocks of all trees: `nodes` (structs of at, hash and the other columns), `levels`, `up`, `subroot`, `root`.

    `leaves` has `tree`, `hash`, the columns of `order` and others that are carried along.
    """
    rounds, tops = _climb(numbered(leaves, order))
    tops = materialize(tops)
    # The groups' roots, in the order of the groups, are the leaves of the tree above.
    n = tops.count()
    groups = ranked(tops, [], [F.col("tree")], "rank", n_rows=n).select(
        F.lit("").alias("tree"), (F.col("rank") - 1).cast("long").alias("at"), F.lit(n).cast("long").alias("m"),
        F.col("top").alias("hash"), F.col("tree").alias("own"))
    upper, final = _climb(groups)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    crown = final.select(F.col("tree").alias("_tree"), F.lit(0).cast("long").alias("_at"), no_path.alias("up"), F.col("top").alias("subroot"), F.col("top").alias("root"))
    held = _descend(upper, crown)
    paths = F.transform("nodes", lambda x: F.struct(x["own"].alias("_tree"), x["hash"].alias("subroot"),
                                                    F.concat(_siblings((x["at"] % BLOCK).cast("int")), F.col("up")).alias("up")))
    crowns = held.select("root", F.explode(paths).alias("_x")).select(
        "_x._tree", F.lit(0).cast("long").alias("_at"), "_x.up", "_x.subroot", "root")
    return _descend(rounds, materialize(crowns))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proofs(docs: DataFrame, columns: list[str], group: str, key: str, claimed: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, path, folded_root, verified) for each row of `docs`.

    A leaf covers `columns`. `claimed` is the leaf digest to be verified, the row's own unless given; `path` are the
    siblings (left, right) from the leaf to the root. Nulls in any column are digested as such; a null group is a tree of
    its own, the first; null keys come first in it. Rows that repeat a key are ordered by their digest, so equal
    rows may change places and nothing else changes. Other columns are ignored; an empty table gives an empty result.
    """
    own = leaf(*[F.col(c) for c in columns])
    digested = docs.select(group_key(F.col(group)).alias("tree"), F.col(key).alias("key"), own.alias("hash"),
                           (own if claimed is None else claimed).alias("claimed"))
    held = manifest(materialize(digested), ["key", "hash", "claimed"])

    def one(x: Column) -> Column:
        return F.struct(x["key"].alias(key), x["hash"].alias("leaf"), x["claimed"].alias("claimed"),
                        F.concat(_siblings((x["at"] % BLOCK).cast("int")), F.col("up")).alias("path"))

    rows = held.select("subroot", "root", F.explode(F.transform("nodes", one)).alias("_x")).select("_x.*", "subroot", "root")
    return rows.withColumn("folded_root", folded(F.col("claimed"), F.col("path"))) \
        .select(key, "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_leaf() -> Column:
    """Leaf of a document of which every second one, by checksum of its id, has lost its line breaks."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), changed)


def op11_merkle(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = proofs(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", tampered_leaf())
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {"op11_merkle": op11_merkle}


# ---------------------------------------------------------------- check SQL

# Levels written out: enough for 3 ** 16 rows of a group, and as many groups.
_SQL_LEVELS = 16


def _sql_tree(name: str, start: str) -> str:
    """Levels of trees from `start` (tree, pos, m, h): each row's run, its place there, until one node remains."""
    parts = [f"{name}0 AS ({start})"]
    for k in range(_SQL_LEVELS):
        parts.append(f"""{name}{k + 1} AS (SELECT tree, pos // 3 AS pos, (m + 2) // 3 AS m,
  CASE WHEN m = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k} GROUP BY tree, pos // 3, m)""")
        # A run of one node of a finished tree has no sibling and is not hashed.
        parts.append(f"""{name}s{k} AS (SELECT a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r, any_value(a.m) AS m
  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.pos // 3 = b.pos // 3 GROUP BY a.tree, a.pos)""")
    return ",\n".join(parts)


def _sql_fold(name: str, start: str, out: str) -> str:
    """From `start` (tree, pos, h, proof, ...) climb: `h` folded with the siblings, `proof` with them added."""
    parts, last = [], start
    for k in range(_SQL_LEVELS):
        parts.append(f"""{out}{k} AS (SELECT f.* EXCLUDE (pos, h, proof), f.pos // 3 AS pos,
  CASE WHEN s.m = 1 THEN f.h ELSE sha256(s.l || f.h || s.r) END AS h, f.proof || s.l || s.r AS proof
  FROM {last} f JOIN {name}s{k} s ON f.tree = s.tree AND f.pos = s.pos)""")
        last = f"{out}{k}"
    return ",\n".join(parts)


def _sql_leaf(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


_SQL = f"""WITH bits AS (SELECT range AS n, list_reduce([range, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS c FROM range(256)),
crcs AS (SELECT list(c ORDER BY n) AS c FROM bits),
sums AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
    lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda x, b: xor(x // 256, crcs.c[xor(x % 256, b) + 1])), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), crcs),
rows AS (SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
    CASE WHEN crc % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS claimed
  FROM documents JOIN sums USING (doc_id)),
placed AS (SELECT *, coalesce('=' || source, '') AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m FROM rows),
{_sql_tree('t', 'SELECT tree, pos, m, leaf AS h FROM placed')},
{_sql_tree('u', f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS m, h, tree AS own FROM t{_SQL_LEVELS}")},
start AS (SELECT doc_id, leaf, tree, pos, claimed AS h, '' AS proof FROM placed),
{_sql_fold('t', 'start', 'f')},
tops AS (SELECT f.doc_id, f.leaf, t.h AS subroot, u.tree, u.pos, f.h, f.proof FROM f{_SQL_LEVELS - 1} f
  JOIN t{_SQL_LEVELS} t USING (tree) JOIN u0 u ON u.own = f.tree),
{_sql_fold('u', 'tops', 'g')}
SELECT g.doc_id, g.leaf, g.subroot, u.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = u.h AS verified
FROM g{_SQL_LEVELS - 1} g, u{_SQL_LEVELS} u"""
ORACLES = {"op11_merkle": _SQL}
