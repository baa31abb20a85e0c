"""The prefix trie of conversations: its nodes, their members, leaves and what sharing them saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize

#: Numbers of turns, depths and ids that one group spans: a huge conversation, or many equal ones, are many groups.
BLOCK = 1024
#: The block of turns without a number, before all others.
FIRST = -(2**40)
NODE = ("depth", "p1", "p2")


def _known(turns: DataFrame, *columns: str) -> DataFrame:
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *columns)


def _block(column: str) -> Column:
    return F.coalesce(F.floor(F.col(column) / BLOCK), F.lit(FIRST))


def _family(column: str = "conv_id") -> Column:
    return F.col(column) - F.pmod(column, F.lit(5))


def _borrowed(column: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(column.cast("string").cast("binary")) % 9


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, block, r, first, second, size): each turn's place in its block of turn numbers, two hashes, its text's bytes.

    Texts go through one shuffle, as turns of one number follow the order of their roles and texts.
    """
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return _known(turns, *empty).withColumn("block", _block("turn")).select(
        "conv_id", "block", F.row_number().over(order).alias("r"), F.xxhash64("role", "text").alias("first"),
        F.xxhash64("text", F.lit(7), "role").alias("second"), F.octet_length("text").cast("long").alias("size"),
    )


def families(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, block, before, n_base, mates) and (conv_id): a block's turns before it, its family's first size and ids (five at most).

    Reads ids and turn numbers alone.
    """
    counts = _known(turns).groupBy("conv_id", _block("turn").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("family", _family())
    sizes = counts.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumn("family", _family())
    is_base = F.col("conv_id") == F.col("family")
    of_family = sizes.groupBy("family").agg(F.coalesce(F.sum(F.when(is_base, F.col("n"))), F.lit(0)).alias("n_base"), F.collect_list("conv_id").alias("mates"))
    return blocks.join(of_family, "family").drop("family", "n"), sizes.select("conv_id")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, size) of every rebuilt conversation's turns, and (conv_id) of all conversations.

    A turn goes to its own conversation if it lies after the borrowed ones, and the first eight of a family's first
    conversation to each of the five that borrows it. k1 and k2 hash the turn together with its depth.
    """
    blocks, ids = families(turns)
    rows = numbered_turns(turns).join(blocks, ["conv_id", "block"]).withColumn("p", F.col("before") + F.col("r"))
    h, p = _borrowed(F.col("conv_id")), F.col("p")
    place = lambda c, d: F.struct(c.cast("long").alias("conv_id"), d.cast("long").alias("depth"))
    none = F.array().cast("array<struct<conv_id:long,depth:long>>")
    own = F.when(p > h, F.array(place(F.col("conv_id"), F.least(h, F.col("n_base")) + p - h))).otherwise(none)
    lent = F.when((F.pmod("conv_id", F.lit(5)) == 0) & (p <= 8), F.transform(F.filter("mates", lambda m: _borrowed(m) >= p), lambda m: place(m, p))).otherwise(none)
    placed = rows.select(F.inline(F.concat(own, lent)), "first", "second", "size")
    k1, k2 = F.xxhash64("depth", "first", "second"), F.xxhash64("second", "depth", F.lit(1), "first")
    return placed.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), "size"), ids


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, tail, ends): a row for each conversation and node on its path, as a table.

    p1 and p2 are 128 bits over the path to the node (the hashes of its turns, which hold their depths, by xor), q1 and
    q2 over the path to its parent, tail the bytes from this depth on, ends whether it is the conversation's last node.
    """
    rows, ids = rebuilt_turns(turns)
    rows = materialize(rows.withColumn("block", F.floor((F.col("depth") - 1) / BLOCK)), "turns")
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"), F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = blocks.select(
        "conv_id", "block", *(zero(F.bit_xor(c).over(earlier)).alias(c) for c in ("b1", "b2")), zero(F.sum("s").over(earlier)).alias("s"),
        F.sum("s").over(whole).alias("total"), F.sum("n").over(whole).alias("n"),
    )
    up_to = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select("conv_id", "block", "depth", "k1", "k2", "size", *(F.bit_xor(k).over(up_to).alias(w) for k, w in (("k1", "w1"), ("k2", "w2"))), F.sum("size").over(up_to).alias("w"))
    p = [F.col("w1").bitwiseXOR(F.col("b1")), F.col("w2").bitwiseXOR(F.col("b2"))]
    nodes = within.join(blocks, ["conv_id", "block"]).select(
        "conv_id", "depth", p[0].alias("p1"), p[1].alias("p2"), p[0].bitwiseXOR(F.col("k1")).alias("q1"), p[1].bitwiseXOR(F.col("k2")).alias("q2"),
        (F.col("total") - F.col("s") - F.col("w") + F.col("size")).alias("tail"), (F.col("depth") == F.col("n")).alias("ends"),
    )
    sums = rows.groupBy("conv_id").agg(F.sum("size").alias("total"))
    nought = F.lit(0).cast("long")
    roots = ids.join(sums, "conv_id", "left").select("conv_id", *(nought.alias(c) for c in ("depth", "p1", "p2", "q1", "q2")), zero(F.col("total")).alias("tail"), F.col("total").isNull().alias("ends"))
    out = materialize(nodes.unionByName(roots), "paths")
    discard(rows)
    return out


def _ends(path_rows: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of nodes where conversations end: the digest of their ids in order.

    Ids meet by node and range of ``BLOCK`` ids, so that a node's members are few strings; their digest is
    taken over a sorted stream, whatever their number.
    """
    chunk = F.floor(F.col("conv_id") / BLOCK).alias("chunk")
    parts = path_rows.where("ends").groupBy(*NODE, chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in it:
            done = []
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield _digests(done)
        if now is not None:
            yield _digests([(*now, sha.hexdigest())])

    return map_batches(parts, digest, "depth long, p1 long, p2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node.

    ``turns`` has conv_id, turn, role and text; its conversations are rebuilt as ``rebuilt_turns`` says. A node is
    owned by its smallest member, and so is all that lies below it on that member's path: each conversation owns a
    suffix of its path (or nothing), found by two minima. A node's subtree then is summed over its members: the bytes of their
    paths from there on, less those that they own, and whether they own a leaf. One group-by over the paths gives
    all nodes at once; parents' owners come by a join of tables, which can be split where one parent has
    many children. Windows span blocks of 1024 turns; nothing gathers a conversation, a node's members or its children.

    Rows without a conv_id are left out. Null turns come first; turns of one number follow the order of role and
    text, and repeated rows each count; null role and text are empty. A conversation without rebuilt turns is a member of
    the root alone. An empty table has no node. Further columns are ignored.
    """
    path_rows = paths(turns)
    owned = path_rows.groupBy(*NODE).agg(F.min(F.struct("conv_id", "tail")).alias("owner"), (F.count(F.lit(1)) == F.count_if("ends")).alias("leaf"), F.first("q1").alias("q1"), F.first("q2").alias("q2"))
    nodes = materialize(owned.select(*NODE, "owner.conv_id", "owner.tail", "leaf", "q1", "q2"), "nodes")
    suffix = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "tail")).alias("top"), F.max("leaf").alias("leaf"))
    suffix = materialize(suffix.select("conv_id", F.col("top.depth").alias("top"), F.col("top.tail").alias("own"), F.col("leaf").cast("long").alias("leaf")), "owners")
    zero = F.lit(0).cast("long")
    own = F.when(F.col("depth") >= F.col("top"), F.col("tail")).otherwise(F.coalesce("own", zero))
    members = path_rows.join(suffix, "conv_id", "left").select(*NODE, "q1", "q2", "conv_id", F.coalesce("leaf", zero).alias("leaf"), (F.col("tail") - own).alias("saved"), zero.alias("child"))
    null = F.lit(None).cast("long")
    children = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), *(null.alias(c) for c in ("q1", "q2", "conv_id")), zero.alias("leaf"), zero.alias("saved"), F.lit(1).cast("long").alias("child"))
    sums = members.unionByName(children).groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("conv_id").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.min("q1").alias("q1"), F.min("q2").alias("q2"),
    )
    whole = materialize(sums.join(_ends(path_rows), [*NODE], "left"), "sums")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    discard(path_rows, suffix)
    return whole.join(parents, ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )


def oracle_sql() -> str:
    """The same from whole paths as lists, in DuckDB."""
    step = "list_reduce(list_prepend(CAST(x AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, i: xor(c >> 1, (c & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS UBIGINT))), lambda x0, d0: {step.replace('CAST(x AS UBIGINT)', 'xor(x0, d0)')}), 4294967295)"
    return f"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS family, CAST({crc} % 9 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS MATERIALIZED (
  SELECT c.conv_id, t.p AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.family AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, t.p - c.h + least(c.h, (SELECT count(*) FROM turns b WHERE b.conv_id = c.family)) AS depth, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
steps AS (SELECT conv_id, depth, text, list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path, count(*) OVER (PARTITION BY conv_id) = depth AS ends FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', [], conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs),
nodes AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM steps GROUP BY path, depth),
kin AS MATERIALIZED (SELECT a.path, count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children, sum(b.saved) AS saved_tokens, count(*) FILTER (WHERE NOT EXISTS (
    SELECT 1 FROM nodes d WHERE d.depth = b.depth + 1 AND d.path[1:b.depth] = b.path)) AS n_leaves
  FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, k.n_leaves, CAST(k.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN kin k ON k.path = n.path LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.path = n.path[1:n.depth - 1]"""
