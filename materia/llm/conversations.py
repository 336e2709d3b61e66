"""A prefix trie of conversations, and its subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Its key is the exclusive or of
128-bit hashes of its turns with their places, a running total along the
conversation (``operators.running``), so even one very long conversation is
spread over many tasks, and texts are read once and never shuffled. A node is
named by its smallest member and its depth. Children are counted, and subtrees
summed, by ``contraction``; what meets a node with very many children or members
does so by broadcast (see ``common.with_group``).

The ids of the conversations that end in a node are hashed in order without being
held: ids of a range of ``2 ** PIECE_BITS`` are one string, and the strings of a
node pass through a hash one after another.

Defined results: turns are in the order of ``turn``, null first, equal ones by the
hash of role and text; null roles and texts are empty; rows without a
conversation's id are in no conversation; rows that repeat are turns of their own;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from materia.llm.common import shared_table, with_group
from materia.llm.contraction import subtree_totals
from materia.operators.running import running

#: Conversations with the same id divided by this share the first turns of the one with the multiple.
FAMILY = 100
#: A conversation's shared turns: the crc32 of its id modulo this.
SHARED = 6
PIECE_BITS = 16
_NODE = ["depth", "a", "b"]


def turns_in_order(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, a, b, points): the turns of each conversation from 1, two hashes of role and text, and code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("long").alias("points")
    )
    return running(turns, ["conv"], [F.col("turn").asc_nulls_first(), "a", "b"], place=("count", None)).drop("turn")


def shared_beginnings(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, length) and turns (conv, place, a, b, points, last), each with its family's first turns.

    Conversation c gets the first h turns of conversation c - c % family, h = crc32(c as text) % shared, and keeps its own
    turns after its first h.
    """
    turns = shared_table(turns, "turns")
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    first = F.col("conv") - F.col("conv") % family
    convs = own.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % shared, "base": first})
    bases = own.filter(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = shared_table(convs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    given = turns.filter((F.col("place") < shared) & (F.col("conv") % family == 0)).withColumnRenamed("conv", "base")
    heads = convs.select("conv", "base", "head", "length").join(given, "base").filter(F.col("place") <= F.col("head"))
    met = with_group(turns, convs.select("conv", "h", "head", "length", "n"), "conv", "n", turns.count())
    rest = met.filter(F.col("place") > F.col("h")).withColumn("place", F.col("head") + F.col("place") - F.col("h"))
    columns = ["conv", "place", "a", "b", "points", (F.col("place") == F.col("length")).alias("last")]
    return convs.select("conv", "length"), heads.select(columns).unionByName(rest.select(columns))


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of rows (depth, a, b, conv): the SHA-256 of the ascending ids, comma-joined."""
    pieces = ends.groupBy(*_NODE, F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["depth", "a", "b", "ends_sha256"]
        node, digest = None, None
        for batch in batches:
            done = []
            for d, a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if node == (d, a, b):
                    digest.update(b",")
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (d, a, b), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=schema)

    return ordered.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``convs``: conv, length; ``turns``: conv, place (1 to length), a, b, points, last. A conversation without turns ends in the root.
    """
    salted = turns.withColumns({"x": F.xxhash64("place", "a", "b"), "y": F.xxhash64("b", "a", "place")})
    paths = running(salted.select("conv", "place", "points", "last", "x", "y"), ["conv"], ["place"], a=("xor", F.col("x")), b=("xor", F.col("y")))
    paths = shared_table(paths.withColumn("depth", F.col("place").cast("long")), "paths")
    below = paths.groupBy(_NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("x").alias("x"), F.min("y").alias("y"), F.min("points").alias("points"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", zero.alias("x"), zero.alias("y"), zero.alias("points"))
    up = {"pd": F.col("depth") - 1, "pa": F.col("a").bitwiseXOR(F.col("x")), "pb": F.col("b").bitwiseXOR(F.col("y"))}
    nodes = shared_table(below.unionByName(root).withColumns(up).drop("x", "y"), "nodes")
    kids = nodes.groupBy(F.col("pd").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*_NODE, F.col("conv_id").alias("parent_conv_id")).join(kids, _NODE)
    parents = shared_table(parents.withColumnsRenamed({"depth": "pd", "a": "pa", "b": "pb"}), "parents")
    linked = with_group(nodes, parents.withColumnRenamed("n_children", "siblings"), ["pd", "pa", "pb"], "siblings", nodes.count()).drop("siblings")
    own = parents.select(F.col("pd").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    linked = linked.join(own, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    linked = linked.withColumns({
        "pd": F.when(F.col("parent_conv_id").isNotNull(), F.col("pd")), "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("points"),
    })
    ends = paths.filter("last").select(*_NODE, "conv").unionByName(convs.filter("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv"))
    linked = shared_table(linked.join(_digests(ends), _NODE, "left").drop("pa", "pb"), "linked")
    totals = subtree_totals(linked, ["conv_id", "depth"], ["parent_conv_id", "pd"], "depth", ["n_leaves", "saved_tokens"])
    return linked.drop("n_leaves", "saved_tokens").join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i:
  [ascii((conv_id::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, (x % 2) * 3988292384) END)"""

ORACLE = f"""
WITH listed AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS s FROM conversations GROUP BY conv_id),
heads AS (SELECT *, xor({_CRC}, 4294967295) % {SHARED} AS h FROM listed),
built AS (SELECT c.conv_id, list_concat(coalesce(base.s[1:c.h], []), c.s[c.h + 1:]) AS s FROM heads AS c LEFT JOIN listed AS base ON base.conv_id = c.conv_id - c.conv_id % {FAMILY}),
paths AS (SELECT conv_id, d, len(s) = d AS last, CASE WHEN d = 0 THEN 0 ELSE length(s[d].text) END AS points, sha256(to_json(s[1:d])::VARCHAR) AS node,
    CASE WHEN d > 0 THEN sha256(to_json(s[1:d - 1])::VARCHAR) END AS parent FROM built, unnest(range(0, len(s) + 1)) AS depths(d)),
nodes AS (SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(points) AS points,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM paths GROUP BY node, d),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
each AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (node)),
totals AS (SELECT top.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * each.points)::BIGINT AS saved_tokens
  FROM each JOIN paths AS top ON top.conv_id = each.conv_id AND top.d <= each.d GROUP BY top.node)
SELECT each.conv_id, each.d AS depth, up.conv_id AS parent_conv_id, each.n_convs, each.n_children, n_leaves, saved_tokens, each.ends_sha256
FROM each JOIN totals USING (node) LEFT JOIN nodes AS up ON up.node = each.parent
"""
