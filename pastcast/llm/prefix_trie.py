"""The trie of conversation prefixes, all prefixes aggregated together by Spark SQL's ROLLUP.

A conversation is cut into blocks of WIDTH turns. A block is a row of positional columns t1 .. tWIDTH (128-bit
ids of the turns) and of the key of the node that the blocks before lead to. ``GROUP BY block, key,
ROLLUP (t1, .., tWIDTH)`` then has a group for every prefix, and grouping_id says how deep it is; a
conversation of any length is several such rows, all of them grouped in the same two passes.

What a subtree sums up is summed over its conversations. Each node belongs to its smallest member; a
conversation that is smallest somewhere is smallest from there on, so it owns the nodes of its path from
one depth on. With E, the words of a conversation above the nodes it owns, and P, the words above a node:

    saved(node) = sum of E over members - E of the smallest member - (members - 1) * P

A childless node is owned by a conversation that ends there, so leaves are counted by conversations too.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD, materialise
from .ordered import joined_sha256, numbered

#: Turns of a block: the positional columns of one ROLLUP.
WIDTH = 8
#: Blocks of a conversation that are summed in one task.
STRETCH = 1024
#: A parent with more than one in so many of all nodes as children is broadcast; there are fewer than that.
HEAVY = 1024
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns_in_order(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text") -> DataFrame:
    """(conv_id, position from 1, turn_id, words) of every row: the order is by turn, nulls first, then role and text.

    Null roles and texts are empty. Rows with a null id belong to no conversation and go. Repeated rows stay
    as turns of their own. Other columns are not read.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = rows.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"),
        empty(text_col).alias("text"))
    placed = numbered(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "turns")
    turn_id = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return placed.select("conv_id", (F.col("before") + F.col("place") + 1).alias("position"), turn_id.alias("turn_id"),
                         F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def _blocks(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per conversation and block: k1, k2 (the node before), t1.., w1.. (words), words before, the path's
    end if it is there; a conversation without turns has one block without turns."""
    at = [(F.col("position") - 1) % WIDTH == i for i in range(WIDTH)]
    keyed = turns.withColumns({
        "block": F.floor((F.col("position") - 1) / WIDTH), "h1": F.xxhash64(F.lit(1), "position", "turn_id"),
        "h2": F.xxhash64(F.lit(2), "position", "turn_id")})
    cut = keyed.groupBy("conv_id", "block").agg(
        *[F.max(F.when(at[i], F.col("turn_id"))).alias(f"t{i + 1}") for i in range(WIDTH)],
        *[F.max(F.when(at[i], F.col("words"))).alias(f"w{i + 1}") for i in range(WIDTH)],
        F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"), F.sum("words").alias("sum_words"))
    bare = convs.join(keyed.select("conv_id").distinct(), "conv_id", "left_anti").select(
        "conv_id", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("binary").alias(f"t{i + 1}") for i in range(WIDTH)],
        *[F.lit(None).cast("long").alias(f"w{i + 1}") for i in range(WIDTH)], F.lit(0).cast("long").alias("h1"),
        F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("sum_words"))
    cut = materialise(cut.unionByName(bare).withColumn("stretch", F.floor(F.col("block") / STRETCH)), "trie-blocks")
    # Sums up to a block: within its stretch, and over the conversation's stretches before.
    sums = [("h1", F.bit_xor, "bitwiseXOR"), ("h2", F.bit_xor, "bitwiseXOR"), ("sum_words", F.sum, "__sub__")]
    over = lambda part: W.partitionBy(*part[:-1]).orderBy(part[-1]).rowsBetween(W.unboundedPreceding, 0)
    upto = lambda part: {f"to_{c}": agg(c).over(over(part)) for c, agg, _ in sums}
    stretches = cut.groupBy("conv_id", "stretch").agg(*[agg(c).alias(c) for c, agg, _ in sums]).withColumns(
        upto(["conv_id", "stretch"])).select("conv_id", "stretch", *[getattr(F.col(f"to_{c}"), back)(F.col(c)).alias(f"from_{c}") for c, _, back in sums])
    placed = cut.withColumns(upto(["conv_id", "stretch", "block"])).join(stretches, ["conv_id", "stretch"])
    before = {f"to_{c}": getattr(F.col(f"to_{c}"), back)(F.col(c)) for c, _, back in sums}
    placed = placed.withColumns(before)
    return placed.select(
        "conv_id", "stretch", "block", *[f"t{i + 1}" for i in range(WIDTH)], *[f"w{i + 1}" for i in range(WIDTH)],
        F.col("to_h1").bitwiseXOR(F.col("from_h1")).alias("k1"), F.col("to_h2").bitwiseXOR(F.col("from_h2")).alias("k2"),
        (F.col("to_sum_words") + F.col("from_sum_words")).alias("words_before"))


def _mark(lane: int, i: int, name: str) -> Column:
    """What the turn at column i of a block adds to a node's key; keys are two such lanes, 128 bits."""
    return F.xxhash64(F.lit(lane), F.col("block") * WIDTH + (i + 1), F.col(name))


def _rolled(blocks: DataFrame, measures: str) -> DataFrame:
    """Every prefix of every block: depth, x1, x2 (its node's key), p1, p2 (its parent's), words above it, own words,
    and ``measures``. The root comes from the first blocks, other empty prefixes are the deepest of the block before."""
    names = [f"t{i + 1}" for i in range(WIDTH)]
    grouped = blocks.sparkSession.sql(f"""
        SELECT block, k1, k2, {', '.join(names)}, grouping_id() AS gid, MAX(words_before) AS words_before,
               {', '.join(f'MAX(w{i + 1}) AS w{i + 1}' for i in range(WIDTH))}, {measures}
        FROM {{blocks}} GROUP BY block, k1, k2, ROLLUP ({', '.join(names)})""", blocks=blocks)
    deep = F.col("deep")
    grouped = grouped.withColumn("deep", WIDTH - F.bit_count("gid"))
    last = F.lit(None).cast("binary")
    for i, name in enumerate(names):
        last = F.when(deep == i + 1, F.col(name)).otherwise(last)
    real = grouped.filter(((deep == 0) & (F.col("block") == 0)) | last.isNotNull())
    depth = F.col("block") * WIDTH + deep

    def key(lane: int, upto):
        out = F.col(f"k{lane}")
        for i, name in enumerate(names):
            out = out.bitwiseXOR(F.when(upto > i, _mark(lane, i, name)).otherwise(F.lit(0)))
        return out

    above, own = F.col("words_before"), F.lit(0).cast("long")
    for i in range(WIDTH):
        above = above + F.when(deep > i + 1, F.col(f"w{i + 1}")).otherwise(F.lit(0))
        own = F.when(deep == i + 1, F.col(f"w{i + 1}")).otherwise(own)
    kept = [f.strip().split(" AS ")[1] for f in measures.split(";")[0].split("\n") if " AS " in f]
    return real.select(depth.alias("depth"), key(1, deep).alias("x1"), key(2, deep).alias("x2"), key(1, deep - 1).alias("p1"),
                       key(2, deep - 1).alias("p2"), above.alias("above"), own.alias("own"), *[k.rstrip(",") for k in kept])


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Adds n_children and parent_conv_id. Parents of very many nodes are few: they are broadcast."""
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    full = materialise(nodes.join(children, ["depth", "x1", "x2"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    total = full.count()
    parents = full.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"),
        (F.col("n_children") * HEAVY > total).alias("heavy"))
    by = ["depth", "p1", "p2"]
    few = F.broadcast(parents.filter("heavy").drop("heavy"))  # fewer than HEAVY rows
    below = full.filter("depth > 0")
    return (below.join(few, by).unionByName(below.join(few, by, "left_anti").join(parents.filter("NOT heavy").drop("heavy"), by))
            .unionByName(full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))))


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 (see ``op12`` in queries.py), and n_ends.

    ``convs`` has every conv_id once (long, not null), those without turns included; ``turns`` has conv_id,
    position (from 1, without gaps), turn_id (binary) and words, as of ``turns_in_order``; other columns are not
    read. A conversation of any length, turns that all share and nodes with very many members, children or ends
    are split over tasks. Without conversations there is no node, not even the root.
    """
    turns = turns.select("conv_id", "position", "turn_id", "words")
    convs = convs.select("conv_id")
    blocks = materialise(_blocks(convs, turns), "trie-rows")
    first = _rolled(blocks, "MIN(conv_id) AS conv_id,\nCOUNT(*) AS n_convs")
    nodes = materialise(_with_parents(first), "trie-parents")
    # What each conversation owns: from which depth on, the words above, a leaf or none.
    owned = nodes.groupBy("conv_id").agg(F.min_by("above", "depth").alias("above"), F.max(
        F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    ways = blocks.groupBy("conv_id", "stretch").agg(F.sum(sum((F.coalesce(f"w{i + 1}", F.lit(0)) for i in range(WIDTH)), F.lit(0).cast("long"))).alias("words"))
    whole = ways.groupBy("conv_id").agg(F.sum("words").alias("all_words")).join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("above", "all_words").alias("outside"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"))
    spread = ways.select("conv_id", "stretch").join(whole, "conv_id")
    second = _rolled(blocks.join(spread, ["conv_id", "stretch"]),
                     "SUM(outside) AS outside,\nMIN_BY(outside, conv_id) AS own_outside,\nSUM(leaf) AS n_leaves")
    ends = _ends(blocks)
    lists = joined_sha256(ends, ["depth", "x1", "x2"], ["conv_id"], "conv_id", ",")
    counts = ends.groupBy("depth", "x1", "x2").agg(F.count(F.lit(1)).alias("n_ends"))
    by = ["depth", "x1", "x2"]
    return (nodes.select(*by, "conv_id", "parent_conv_id", "n_convs", "n_children", "above")
            .join(second.select(*by, "outside", "own_outside", "n_leaves"), by)
            .join(lists.join(counts, by), by, "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    (F.col("outside") - F.col("own_outside") - (F.col("n_convs") - 1) * F.col("above")).alias("saved_tokens"),
                    F.coalesce("sha256", F.lit(_EMPTY)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0).cast("long")).alias("n_ends")))


def _ends(blocks: DataFrame) -> DataFrame:
    """(depth, x1, x2, conv_id): the node at which each conversation ends."""
    names = [f"t{i + 1}" for i in range(WIDTH)]
    tops = blocks.groupBy("conv_id").agg(F.max("block").alias("block"))
    last = blocks.join(tops.select("conv_id", "block"), ["conv_id", "block"])
    x = {lane: F.col(f"k{lane}") for lane in (1, 2)}
    deep = F.lit(0).cast("long")
    for i, name in enumerate(names):
        there = F.col(name).isNotNull()
        deep = deep + there.cast("long")
        for lane in x:
            x[lane] = x[lane].bitwiseXOR(F.when(there, _mark(lane, i, name)).otherwise(F.lit(0)))
    return last.select((F.col("block") * WIDTH + deep).alias("depth"), x[1].alias("x1"), x[2].alias("x2"), "conv_id")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(convs, turns) with shared beginnings: conversation c starts with the first h turns of conversation
    c - c % ``every`` (those it has), h = crc32(c in decimal) % ``heads``, and goes on with its own turns after its first h."""
    lengths = turns.groupBy("conv_id").agg(F.max("position").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = materialise(lengths.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(
        lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
        .select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))).alias("lent")), "trie-convs")
    starts = turns.filter(F.col("position") < heads).withColumnRenamed("conv_id", "base")
    lent = convs.join(starts, "base").filter("position <= lent").select("conv_id", "position", "turn_id", "words")
    # A conversation of any length meets its row of convs in slices of its positions.
    sliced = turns.withColumn("slice", F.floor(F.col("position") / (STRETCH * WIDTH)))
    slices = sliced.select("conv_id", "slice").distinct().join(convs.select("conv_id", "h", "lent"), "conv_id")
    own = sliced.join(slices, ["conv_id", "slice"]).filter("position > h").select(
        "conv_id", (F.col("position") - F.col("h") + F.col("lent")).alias("position"), "turn_id", "words")
    return convs.select("conv_id"), lent.unionByName(own)
