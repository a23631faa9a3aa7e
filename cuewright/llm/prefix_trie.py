"""Prefix trie of conversations: whole blocks of turns are grouped by digest first, turns only where blocks diverge."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import numbered, stored
from cuewright.plans.sizes import broadcast_if_small
from cuewright.session import written_once

#: Turns of a block; blocks of one window of a running scan; conversation ids of one piece of a node's list.
BLOCK = 8
SCAN_BLOCKS = 4096
LIST_IDS = 512

NODE = ("depth", "p1", "p2")


def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; null role and text count as empty."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.md5(F.concat(part(F.coalesce(role.cast("string"), F.lit(""))), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, place (0, 1, ... by turn, null first, ties by digest), digest, bytes (of the text), first, n_own.

    Rows without a conv_id take no part. Turns are numbered by one range sort over digests, so texts are hashed where
    they are read and one conversation may span many tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    placed = numbered(rows, ["conv_id", "turn", "digest"], "trie-turns")
    firsts = placed.groupBy(F.col("conv_id").alias("of_conv")).agg(F.min("row_number").alias("first"), F.count("*").alias("n_own"))
    out = placed.join(firsts, F.col("conv_id") == F.col("of_conv")).withColumn("place", F.col("row_number") - F.col("first"))
    return out.select("conv_id", "place", "digest", "bytes", "n_own")


def _lanes(place: Column, digest: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a digest at a place. Exclusive or over places names a sequence in any order of work, so
    prefixes can be scanned in blocks."""
    return F.xxhash64(place, digest), F.xxhash64(digest, F.lit("second lane"), place)


def _scanned(df: DataFrame, key: str, order: str, totals: dict[str, str], reverse: bool = False) -> DataFrame:
    """Add ``run_<c>`` for each column: the running ``bit_xor`` (inclusive) or ``sum`` (exclusive) over ``order`` per key.

    Windows hold at most SCAN_BLOCKS rows; what lies in earlier windows is summed up once per window and joined, which concerns only keys with
    more rows than that.
    """
    made = {"bit_xor": F.bit_xor, "sum": F.sum}
    sort = F.col(order).desc() if reverse else F.col(order).asc()
    block = F.floor(F.col(order) / SCAN_BLOCKS).cast("long")
    cut = df.withColumn("_scan", block)
    local = Window.partitionBy(key, "_scan").orderBy(sort)
    frame = {"bit_xor": local.rowsBetween(Window.unboundedPreceding, 0), "sum": local.rowsBetween(Window.unboundedPreceding, -1)}
    cut = cut.withColumns({f"run_{c}": F.coalesce(made[kind](c).over(frame[kind]), F.lit(0).cast("long")) for c, kind in totals.items()})
    sums = df.groupBy(F.col(key).alias("_key"), block.alias("_of")).agg(*[made[kind](c).alias(f"all_{c}") for c, kind in totals.items()])
    longest = sums.groupBy("_key").agg(F.max("_of").alias("_top")).where("_top > 0").withColumnRenamed("_key", "_long")
    sums = sums.join(broadcast_if_small(longest), F.col("_key") == F.col("_long")).drop("_long", "_top")
    over = Window.partitionBy("_key").orderBy(F.col("_of").desc() if reverse else F.col("_of").asc()).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_key", "_of", *[F.coalesce(made[kind](f"all_{c}").over(over), F.lit(0).cast("long")).alias(f"pre_{c}") for c, kind in totals.items()])
    cut = cut.join(before, (F.col(key) == F.col("_key")) & (F.col("_scan") == F.col("_of")), "left")
    join = {"bit_xor": lambda a, b: a.bitwiseXOR(b), "sum": lambda a, b: a + b}
    whole = {f"run_{c}": join[kind](F.col(f"run_{c}"), F.coalesce(F.col(f"pre_{c}"), F.lit(0).cast("long"))) for c, kind in totals.items()}
    return cut.withColumns(whole).drop("_scan", "_key", "_of", *[f"pre_{c}" for c in totals])


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """conv_id, j, e (depth at the end), b1, b2 and a1, a2 (names of the prefixes before and after): a row per block of a conversation."""
    rows = turns.groupBy("conv_id", F.floor(F.col("place") / block).cast("long").alias("j"))
    rows = rows.agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.count("*").alias("size"))
    rows = _scanned(rows, "conv_id", "j", {"x1": "bit_xor", "x2": "bit_xor"})
    before = [F.col(f"run_x{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"b{i}") for i in (1, 2)]
    return rows.select("conv_id", "j", (F.col("j") * block + F.col("size")).alias("e"), F.col("run_x1").alias("a1"), F.col("run_x2").alias("a2"), *before)


def _ends(finals: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256: the digest of the ids of the conversations that end at a node, ascending, comma-joined.

    The ids are numbered by one range sort and joined to pieces of at most LIST_IDS in parallel; a task then feeds a node's pieces to
    SHA-256 one after the other, as that digest demands, and holds no more than a batch of them.
    """
    placed = numbered(finals, [*NODE, "conv_id"], "trie-ends")
    piece = F.floor(F.col("row_number") / LIST_IDS).cast("long").alias("piece")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = placed.groupBy(*NODE, piece).agg(F.array_join(ids, ",").alias("ids"))
    pieces = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for batch in batches:
            out = []
            for depth, p1, p2, ids in zip(batch["depth"], batch["p1"], batch["p2"], batch["ids"]):
                if (depth, p1, p2) != at:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (depth, p1, p2), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=[*NODE, "ends_sha256"])

    return pieces.select(*NODE, "ids").mapInPandas(run, "depth long, p1 long, p2 long, ends_sha256 string")


def _named(df: DataFrame, prefix: str, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in names], *[c for c in df.columns if c not in names])


def _same(prefix: str, depth: Column, p1: Column, p2: Column) -> Column:
    return (F.col(f"{prefix}depth") == depth) & (F.col(f"{prefix}p1") == p1) & (F.col(f"{prefix}p2") == p2)


def prefix_nodes(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node.

    ``turns``: conv_id, place (0, 1, ... without gaps), digest, bytes; ``convs``: conv_id, each once, turnless ones too. A node is a distinct
    sequence of first turns, named by its smallest conversation and its depth; the root has depth 0 and no parent.

    Conversations are cut into blocks of ``block`` turns. A running scan names the prefix at every block's end, and one
    grouping finds the distinct blocks with the number and the smallest of the conversations that share each. Only one conversation's
    turns are read again for a distinct block; turns are compared only under prefixes that go on in more than one way. Sums over a node's
    subtree need no rounds: what a block saves and the leaf at its end are booked on the smallest conversation in it, so a
    subtree's total is the sum over its conversations of what they own further on, one more scan. No node's members are gathered, and neither the depth nor
    the number of conversations at a node bounds it.

    Repeated turns are turns of their own. An empty ``convs`` gives no rows, since the root has no smallest member.
    """
    h1, h2 = _lanes(F.col("place"), F.col("digest"))
    turns = written_once(turns.select("conv_id", "place", h1.alias("h1"), h2.alias("h2"), "bytes"), "trie-rebuilt")
    convs = written_once(convs.select("conv_id"), "trie-convs")
    blocks = written_once(_blocks(turns, block), "trie-blocks")

    distinct = blocks.groupBy("e", "a1", "a2").agg(F.count("*").alias("w"), F.min("conv_id").alias("m"), *[F.min(c).alias(c) for c in ("j", "b1", "b2")])
    distinct = written_once(distinct, "trie-distinct")
    forks = distinct.groupBy(F.col("j").alias("f_j"), F.col("b1").alias("f_b1"), F.col("b2").alias("f_b2")).agg(F.count("*").alias("ways"))
    goes_on = (F.col("f_j") == F.col("j") + 1) & (F.col("f_b1") == F.col("a1")) & (F.col("f_b2") == F.col("a2"))
    under = (F.col("f_j") == F.col("j")) & (F.col("f_b1") == F.col("b1")) & (F.col("f_b2") == F.col("b2"))
    distinct = distinct.join(forks, under).withColumn("fork", F.col("ways") > 1).drop("f_j", "f_b1", "f_b2", "ways")
    distinct = distinct.join(forks, goes_on, "left").withColumn("goes_on", F.col("ways").isNotNull()).drop("f_j", "f_b1", "f_b2", "ways")

    mine = turns.select(F.col("conv_id").alias("t_conv"), F.floor(F.col("place") / block).cast("long").alias("t_j"), "place", "h1", "h2", "bytes")
    reps = distinct.join(mine, (F.col("m") == F.col("t_conv")) & (F.col("j") == F.col("t_j"))).drop("t_conv", "t_j")
    inside = Window.partitionBy("m", "j").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    reps = reps.withColumns({f"p{i}": F.bit_xor(f"h{i}").over(inside).bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    reps = reps.withColumns({f"q{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"h{i}")) for i in (1, 2)}).withColumn("depth", F.col("place") + 1)
    reps = written_once(reps.drop("h1", "h2", "place", "b1", "b2"), "trie-turns-of-blocks")
    # Turns under a fork are compared; elsewhere a block's members share all its nodes.
    refined = _named(reps.where("fork").groupBy(*NODE).agg(F.sum("w").alias("n_convs"), F.min("m").alias("conv_id")), "n_", *NODE)
    forked = reps.where("fork").join(refined, _same("n_", F.col("depth"), F.col("p1"), F.col("p2"))).drop("n_depth", "n_p1", "n_p2")
    plain = reps.where("not fork").withColumns({"n_convs": F.col("w"), "conv_id": F.col("m")})
    valued = forked.unionByName(plain).withColumn("value", F.col("bytes") * (F.col("w") - (F.col("m") == F.col("conv_id")).cast("long")))
    rest = Window.partitionBy("m", "j").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    valued = valued.withColumn("from_here", F.sum("value").over(rest))
    last = (F.col("depth") == F.col("e")) & ~F.col("goes_on") & (F.col("n_convs") == F.col("w"))
    valued = valued.withColumn("leaf", F.max(last.cast("long")).over(Window.partitionBy("m", "j")))
    valued = written_once(valued.drop("value", "goes_on"), "trie-valued")

    owned = valued.groupBy(F.col("m").alias("o_conv"), F.col("j").alias("o_j")).agg(F.max("from_here").alias("saves"), F.max("leaf").alias("leaves"))
    booked = blocks.select("conv_id", "j", "e", "a1", "a2").join(owned, (F.col("conv_id") == F.col("o_conv")) & (F.col("j") == F.col("o_j")), "left")
    booked = booked.select("conv_id", "j", "e", "a1", "a2", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("saves", "leaves")])
    below = _scanned(booked, "conv_id", "j", {"saves": "sum", "leaves": "sum"}, reverse=True)
    below = below.groupBy("e", "a1", "a2").agg(F.sum("run_saves").alias("saves_below"), F.sum("run_leaves").alias("leaves_below"))
    below = _named(below, "z_", "e", "a1", "a2")
    whole = valued.join(below, (F.col("e") == F.col("z_e")) & (F.col("a1") == F.col("z_a1")) & (F.col("a2") == F.col("z_a2")))
    whole = whole.withColumns({"saved_tokens": F.col("from_here") + F.col("saves_below"), "n_leaves": F.col("leaf") + F.col("leaves_below")})
    columns = [*NODE, "q1", "q2", "conv_id", "n_convs", "n_leaves", "saved_tokens"]
    shared = whole.where("fork").groupBy(*columns[:7]).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    nodes = written_once(whole.where("not fork").select(*columns).unionByName(shared.select(*columns)), "trie-nodes")

    members = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where("n > 0")
    tops = nodes.where("depth = 1").agg(F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = members.join(F.broadcast(tops)).select(  # one row each
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), "conv_id", F.col("n").alias("n_convs"),
        F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
    )
    nodes = nodes.unionByName(root)

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("c_depth"), F.col("q1").alias("c_p1"), F.col("q2").alias("c_p2")).agg(F.count("*").alias("n_children"))
    last_blocks = blocks.groupBy("conv_id").agg(F.max(F.struct(F.col("e").alias("depth"), F.col("a1").alias("p1"), F.col("a2").alias("p2"))).alias("end"))
    turnless = convs.join(last_blocks.select("conv_id"), "conv_id", "left_anti").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id")
    ends = _named(_ends(last_blocks.select("end.*", "conv_id").unionByName(turnless)), "s_", *NODE)
    here = (F.col("depth"), F.col("p1"), F.col("p2"))
    out = nodes.join(children, _same("c_", *here), "left").join(ends, _same("s_", *here), "left")
    parents = nodes.select(F.col("depth").alias("u_depth"), F.col("p1").alias("u_p1"), F.col("p2").alias("u_p2"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, _same("u_", F.col("depth") - 1, F.col("q1"), F.col("q2")), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """``prefix_nodes`` of the conversations as they are (conv_id, turn, role, text), and the last turn's role and text.

    Turns are ordered by ``turn`` (null first), ties by digest; a null role or text is empty; rows without a conv_id take no part.
    """
    turns = turn_rows(conversations)
    nodes = prefix_nodes(turns, turns.select("conv_id").distinct(), block)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    words = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("w_conv"), turn_digest(F.col("role"), F.col("text")).alias("w_digest"), text("role").alias("role"), text("text").alias("text"))
    words = words.groupBy("w_conv", "w_digest").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    at = turns.select(F.col("conv_id").alias("w_conv"), (F.col("place") + 1).alias("w_depth"), F.col("digest").alias("w_digest"))
    last = at.join(words, ["w_conv", "w_digest"]).drop("w_digest")
    return nodes.join(last, (F.col("conv_id") == F.col("w_conv")) & (F.col("depth") == F.col("w_depth")), "left").drop("w_conv", "w_depth")


def grafted(turns: DataFrame, every: int, modulus: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared starts: (turns, convs) for ``prefix_nodes``.

    Conversation c becomes the first h = crc32(c) % ``modulus`` turns of conversation c - c % ``every`` (fewer or none where it has no more), then its
    own turns after its first h. ``turns`` as by ``turn_rows``. A conversation lends at most ``modulus`` - 1 turns to fewer than 2 * ``every`` others.
    """
    convs = turns.groupBy("conv_id").agg(F.max("n_own").alias("n_own"))
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % modulus).cast("long"))
    convs = written_once(convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % every), "trie-conversations")
    lender = convs.select(F.col("conv_id").alias("l_conv"), F.col("n_own").alias("lent"))
    convs = convs.join(lender, F.col("base") == F.col("l_conv"), "left")
    convs = convs.withColumn("k", F.least(F.col("h"), F.coalesce("lent", F.lit(0)))).select(F.col("conv_id").alias("c_conv"), "base", "h", "k")
    own = turns.join(convs, F.col("conv_id") == F.col("c_conv")).where(F.col("place") >= F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "digest", "bytes")
    starts = turns.where((F.col("place") < modulus) & (F.col("conv_id") % every == 0)).drop("n_own")
    lent = starts.join(convs, F.col("conv_id") == F.col("base")).where(F.col("place") < F.col("h"))
    lent = lent.select(F.col("c_conv").alias("conv_id"), "place", "digest", "bytes")
    return own.unionByName(lent), convs.select(F.col("c_conv").alias("conv_id"))
