"""Prefix trie of conversations by van Emde Boas recursion.

A sequence of turns is cut at half its depth, again and again: the distinct
halves in front of a cut are the sequences of an upper trie, the halves behind
it those of a lower forest with one trie per cut prefix.  All upper and lower
tries of one depth are cut in the same Spark step, so a trie of depth ``D``
takes ``log2(D)`` steps and no row ever holds a whole sequence.

1. *Names of blocks.*  Pairs of neighbouring turns, of pairs, and so on are
   named from the bottom up.  A name is a 128-bit digest of the two names.
2. *Cuts.*  A piece is (root, content): the name of the prefix in front of it
   and the name of its own turns.  Its left half keeps the root, its right half
   hangs below the cut prefix, whose name is the digest of root and left half.
   Equal pieces become one, with the smallest conversation and the number of
   conversations, so shared prefixes are cut once.  Pieces of one turn are the
   nodes; the cuts name them.
3. *Grafts.*  What hangs below a cut prefix within its lower trie is summed and
   added to it, the deepest cuts first.  A node of depth ``d`` is the cut prefix
   of the step whose block size divides ``d``, so each node is grafted once.

Conversations of any length are rows per turn throughout; hot prefixes are
merged by partial aggregates.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, partitions

WORD = "[^\\x20\\x09-\\x0D]+"
HEAD = 3  # the most turns that a rebuilt conversation borrows
CHUNK = 4096
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
         "saved_tokens", "ends_sha256")


def root_name() -> Column:
    return F.unhex(F.lit("00" * 16))


def digest(*parts: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def numbered_turns(table: DataFrame, id_col: str, turn_col: str, role_col: str,
                   text_col: str) -> DataFrame:
    """``conv, pos, name, words``: turns in order, counted from 0.

    Turns are sorted within chunks of 1024 turn numbers, so that one long
    conversation is not one task; earlier chunks are counted.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = table.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("_t"),
        digest(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"))
        .alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = rows.withColumn("_c", F.coalesce(F.floor(F.col("_t") / 1024), F.lit(-(2**62))))
    sizes = rows.groupBy("conv", "_c").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("conv", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    order = Window.partitionBy("conv", "_c").orderBy(F.asc_nulls_first("_t"), "name")
    return (rows.withColumn("_r", F.row_number().over(order)).join(offsets, ["conv", "_c"])
            .select("conv", (F.col("_b") + F.col("_r") - 1).alias("pos"), "name", "words"))


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """Conversation ``c`` starts with the first ``crc32(c) % 4`` turns of
    conversation ``c - c % 20`` in place of its own."""
    base, head = F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string")) % 4
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    lent = convs.select(F.col("conv").alias("base"), F.least("n", F.lit(HEAD)).alias("lent"))
    borrowers = convs.select("conv", base.alias("base"), head.alias("head"))
    heads = (borrowers.join(turns.where((F.col("pos") < HEAD) & (F.col("conv") % 20 == 0))
                            .withColumnRenamed("conv", "base"), "base")
             .where(F.col("pos") < F.col("head")).select("conv", "pos", "name", "words"))
    own = (turns.withColumns({"base": base, "head": head}).where(F.col("pos") >= F.col("head"))
           .join(lent, "base", "left").select(
               "conv", (F.col("pos") - F.col("head") + F.least(
                   "head", F.coalesce("lent", F.lit(0)))).alias("pos"), "name", "words"))
    return heads.unionByName(own)


def block_pairs(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Level ``k``: both halves of each block of ``2**k`` turns (index ``k``)."""
    blocks = turns.select("conv", F.col("pos").alias("j"), "name", F.lit(1).cast("long").alias("n"),
                          "words")
    out = [blocks]
    for k in range(1, levels + 1):
        even = F.col("j") % 2 == 0
        side = lambda c, left: F.max(F.when(even if left else ~even, F.col(c)))
        words = [side("words", True).alias("lw"), side("words", False).alias("rw")] if k == 1 else []
        pairs = cut(blocks.groupBy("conv", F.shiftright("j", 1).alias("j")).agg(
            side("name", True).alias("left"), side("name", False).alias("right"),
            side("n", True).alias("left_n"), F.sum("n").alias("n"), *words))
        out.append(pairs)
        blocks = pairs.select("conv", "j", F.when(F.col("right").isNull(), digest(F.col("left")))
                              .otherwise(digest("left", "right")).alias("name"), "n")
    return out + [blocks]


def cut_pieces(pieces: DataFrame, pairs: list[DataFrame], levels: int):
    """Pieces of one turn, and the cut prefixes of every level."""
    cuts = []
    for k in range(levels - 1, -1, -1):
        halves = pieces.drop("words").join(pairs[k + 1].drop("n"), ["conv", "j"]).withColumn(
            "below", digest("root", "left"))
        whole = F.col("right").isNull()
        words = (F.col("lw"), F.col("rw")) if k == 0 else (F.lit(None).cast("long"),) * 2
        grown = F.concat("ups", F.array(F.struct(F.lit(k).alias("k"), F.col("below").alias("x"))))
        none = F.lit(None).cast("binary")
        sides = F.array(
            F.struct(F.col("root").alias("root"), F.col("ups").alias("ups"), F.col("left").alias(
                "name"), (F.col("j") * 2).alias("j"), (F.col("left_n") == 2**k).alias("full"),
                F.when(whole, F.col("ends")).otherwise(none).alias("ends"), words[0].alias("words")),
            F.when(~whole, F.struct(
                F.col("below").alias("root"), grown.alias("ups"), F.col("right").alias("name"),
                (F.col("j") * 2 + 1).alias("j"), F.lit(False).alias("full"),
                F.col("ends").alias("ends"), words[1].alias("words"))))
        pieces = cut(halves.select("conv", "n", F.explode(sides).alias("s")).where("s is not null")
                     .select("conv", "n", "s.*").groupBy("root", "name", "j").agg(
                         F.min("conv").alias("conv"), F.sum("n").alias("n"),
                         F.first("ups").alias("ups"), F.max("full").alias("full"),
                         F.max("ends").alias("ends"), F.max("words").alias("words")))
        cuts.append(pieces.where("full").select(
            digest("root", "name").alias("node"), "conv",
            ((F.col("j") + 1) * 2**k).alias("depth"), F.lit(k).alias("k")))
    names = cuts[0]
    for more in cuts[1:]:
        names = names.unionByName(more)
    return pieces, names


def graft(nodes: DataFrame, levels: int) -> DataFrame:
    """``node, n_leaves, saved_tokens`` summed over each node's subtree.

    ``nodes`` has ``node, k, ups`` and the node's own values.  All nodes below
    a cut prefix that are not cuts of the same or an earlier step count with
    their own values; earlier cuts count with their totals.
    """
    values = ("n_leaves", "saved_tokens")
    sums = [F.sum(c).alias(c) for c in values]
    below = nodes.select("k", F.explode("ups").alias("u"), *values).where("k < u.k").groupBy(
        F.col("u.x").alias("node")).agg(*sums)

    def plus(rows: DataFrame, more: DataFrame) -> DataFrame:
        more = more.select("node", *[F.col(c).alias(f"_{c}") for c in values])
        return rows.join(more, "node", "left").select("node", "k", "ups", *[
            (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in values])

    own = cut(plus(nodes.select("node", "k", "ups", *values), below))
    done: list[DataFrame] = []
    for k in range(levels - 1, -1, -1):
        level = own.where(F.col("k") == k)
        if done:
            above = done[0]
            for more in done[1:]:
                above = above.unionByName(more)
            at = F.element_at(F.filter("ups", lambda u: u["k"] == k), 1)["x"]
            level = plus(level, above.groupBy(at.alias("node")).agg(*sums))
        done.append(cut(level) if k else level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("node", *values)


def _hash_lists(batches):
    """Chunks of id lists, sorted by key and chunk -> one digest per key.

    Only the running digest is held, however long a list is.
    """
    key, running, done = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())],
            names=["ends", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch["ends"].to_pylist(), batch["ids"].to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if done:
            yield flush()
            done = []
    if key is not None:
        done.append((key, running.hexdigest()))
        yield flush()


def ending_lists(ends: DataFrame) -> DataFrame:
    """``ends, ends_sha256``: digest of the sorted, comma-joined ``conv`` per key."""
    chunks = ends.groupBy("ends", F.floor(F.col("conv") / CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")),
                     ",").alias("ids"))
    return (chunks.repartition(partitions(ends.sparkSession), "ends")
            .sortWithinPartitions("ends", "chunk").select("ends", "ids")
            .mapInArrow(_hash_lists, "ends binary, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (``conv, pos, name, words``).

    ``convs`` lists every ``conv``, those without turns included.
    """
    turns, convs = cut(turns), cut(convs)
    longest = turns.agg(F.max("pos")).first()[0]
    everyone = convs.agg(F.struct(F.count("*").alias("n"), F.min("conv").alias("conv"))).scalar()
    bare = F.sha2(F.lit("").cast("binary"), 256)
    levels = int(longest + 1).bit_length() if longest is not None else 0  # 2**levels > depth
    pairs = block_pairs(turns, levels)
    whole = pairs[-1].where("j = 0").select("conv", F.col("name").alias("ends"))
    ends = cut(ending_lists(convs.join(whole, "conv", "left").select(
        "conv", F.coalesce("ends", root_name()).alias("ends"))))
    pieces = whole.groupBy("ends").agg(F.min("conv").alias("conv"), F.count("*").alias("n")).select(
        root_name().alias("root"), "conv", F.lit(0).cast("long").alias("j"), "n", "ends",
        F.array().cast("array<struct<k:int,x:binary>>").alias("ups"),
        F.lit(None).cast("long").alias("words"))
    ended = F.coalesce(ends.where(F.col("ends") == root_name()).agg(F.max("ends_sha256")).scalar(), bare)
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where(
        "conv is not null").withColumn("ends_sha256", ended)
    if not levels:
        return root.select(
            F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
            F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"), "ends_sha256")
    single, names = cut_pieces(pieces, pairs, levels)
    names = cut(names)
    children = single.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = single.select("conv", (F.col("j") + 1).alias("depth"), "n", "root", "ups", "ends", "words")
    nodes = cut(names.join(nodes, ["conv", "depth"]).join(children, "node", "left").select(
        "node", "conv", "depth", "k", "root", "ups", "ends",
        F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("words")).alias("saved_tokens")))
    totals = graft(nodes, levels)
    # Children of the root need no join; a hot parent deeper down has one row on its side.
    parents = names.select(F.col("node").alias("root"), F.col("conv").alias("parent"))
    deep = nodes.drop("n_leaves", "saved_tokens").join(totals, "node")
    top = F.col("depth") == 1
    linked = deep.where(top).withColumn("parent", everyone["conv"]).unionByName(
        deep.where(~top).join(parents, "root").select(*deep.columns, "parent"))
    out = linked.join(ends, "ends", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
        "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", bare).alias("ends_sha256"))
    sums = nodes.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
                     F.sum(top.cast("long")).alias("n_children"))
    sums = sums.agg(F.struct(*[F.first(c).alias(c) for c in sums.columns])).scalar()
    first = root.select(
        F.col("conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce(sums["n_children"], F.lit(0)).alias("n_children"),
        F.coalesce(sums["n_leaves"], F.lit(1)).alias("n_leaves"),
        F.coalesce(sums["saved_tokens"], F.lit(0)).alias("saved_tokens"), "ends_sha256")
    return first.unionByName(out)


def conversation_trie(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text",
                      share_heads: bool = False) -> DataFrame:
    """One row per node of the prefix trie of all conversations.

    A node is a distinct sequence of first turns (role, text); ``conv_id`` is
    the smallest conversation that starts with it.  ``n_convs`` counts the
    members, ``n_children`` the longer nodes by one turn, ``n_leaves`` the
    childless nodes of the subtree; ``saved_tokens`` sums ``(members - 1)``
    times the words of the node's last turn over the subtree: what a cache of
    shared prefixes saves.  ``ends_sha256`` hashes the members that end there.
    With ``share_heads`` conversations are rebuilt by ``with_shared_heads``.

    Defined cases: rows with a NULL conversation take no part; a NULL turn
    comes first, equal turns are ordered by a digest of role and text, and a
    repeated row is one more turn; a NULL role or text is empty; an empty
    table gives no node, a table of turnless conversations only the root.
    """
    plain = table.select(*(F.col(f"`{c}`").alias(a) for c, a in (
        (id_col, "c"), (turn_col, "t"), (role_col, "r"), (text_col, "x"))))
    turns = cut(numbered_turns(plain, "c", "t", "r", "x"))
    convs = turns.select("conv").distinct()
    return trie(with_shared_heads(turns) if share_heads else turns, convs).select(*NODES)


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"),
                             share_heads=True)
