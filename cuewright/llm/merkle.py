"""Merkle manifest of a dataset: runs hashed level by level, and proofs for every leaf by pointer jumping."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.llm.common import numbered, stored
from cuewright.plans.sizes import broadcast_if_small, hinted

#: The tree above the groups' subroots; the trees of groups are named by the number of their first leaf.
TOP = -1
#: Most nodes a round of jumps may broadcast; a node's segments hold at most fanout - 1 digests of 32 bytes a level.
JUMP_ROWS = 8192

SEGMENTS = "array<struct<left:binary,right:binary>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the framed values."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf digest and its proof lead to."""
    as_hex = lambda b: F.lower(F.hex(b))
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(as_hex(s["left"]), d, as_hex(s["right"])), 256))


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof as one hex string, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.lower(F.concat(F.hex(s["left"]), F.hex(s["right"])))), "")


def _joined(members: Column, field_name: str = "d") -> Column:
    return F.array_join(F.transform(members, lambda m: m[field_name]), "")


def _with_steps(runs: DataFrame) -> DataFrame:
    """One row per member of each run, with its siblings as ``step``."""
    rows = runs.select("*", F.posexplode("m").alias("_i", "x"))
    left = F.unhex(_joined(F.slice("m", F.lit(1), F.col("_i"))))
    right = F.unhex(_joined(F.slice("m", F.col("_i") + 2, F.size("m"))))
    return rows.withColumn("step", F.struct(left.alias("left"), right.alias("right"))).drop("m", "_i")


@dataclass
class Manifest:
    """Level tables of the hash tree.

    ``leaves`` and ``levels[l]`` hold runs: tree, n (nodes of that tree on that level), run, m (members: i, d and what
    they carry). ``subroots``: tree, height, d. ``top`` are the run tables above the subroots.
    """

    fanout: int
    levels: list[DataFrame] = field(default_factory=list)
    subroots: DataFrame | None = None
    top: list[DataFrame] = field(default_factory=list)
    root: str | None = None
    root_name: tuple[int, int, int] = (TOP, 0, 0)
    height: int = 0


def _built(nodes: DataFrame, fanout: int, carried: list[str]) -> tuple[list[DataFrame], DataFrame, int]:
    """Run tables level by level, what remains of each tree (tree, height, d), and the greatest height.

    ``nodes``: tree, pos, n, d. A run has at most ``fanout`` members, and each level is a ``fanout``-th of the one below.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops, level = [], [], 0
    while True:
        extra = carried if level == 0 else []
        tops.append(nodes.where("n = 1").select("tree", F.lit(level).alias("height"), "d"))
        if level and most <= 1:
            break
        member = F.struct((F.col("pos") % fanout).alias("i"), "d", *extra)
        run = F.floor(F.col("pos") / fanout).cast("long").alias("run")
        runs = stored(nodes.groupBy("tree", "n", run).agg(F.array_sort(F.collect_list(member)).alias("m")), f"merkle-runs-{level}")
        levels.append(runs)
        if most <= 1:
            break
        up = F.ceil(F.col("n") / fanout).cast("long").alias("n")
        nodes = runs.where("n > 1").select("tree", F.col("run").alias("pos"), up, F.sha2(_joined(F.col("m")), 256).alias("d"))
        most, level = -(-most // fanout), level + 1
    return levels, stored(reduce(DataFrame.unionByName, tops), "merkle-subroots"), level


def build(leaves: DataFrame, group: str, order: list[str], fanout: int = 8) -> Manifest:
    """The manifest of ``leaves`` (a row per leaf with ``leaf``, the group, the order and carried columns).

    Groups are ordered null first, else bytewise; inside a group leaves ascend by ``order``, then digest. Rows are numbered
    by one range sort, so that a group with a third of all rows spreads over tasks.
    """
    sorted_ = numbered(leaves, [group, *order, "leaf"], "merkle-leaves")
    trees = sorted_.groupBy(F.col(group).alias("_group")).agg(F.min("row_number").alias("tree"), F.count("*").alias("n"))
    trees = broadcast_if_small(stored(trees, "merkle-trees"))
    placed = sorted_.join(trees, F.col(group).eqNullSafe(F.col("_group"))).withColumn("pos", F.col("row_number") - F.col("tree"))
    carried = [c for c in leaves.columns if c != "leaf"]
    nodes = placed.select("tree", "n", "pos", F.col("leaf").alias("d"), *carried)
    out = Manifest(fanout)
    out.levels, out.subroots, height = _built(nodes, fanout, carried)
    ranked = numbered(out.subroots, ["tree"], "merkle-ranks")
    groups = ranked.count()
    if not groups:
        return out
    named = ranked.select(F.lit(TOP).cast("long").alias("tree"), F.lit(groups).cast("long").alias("n"), F.col("row_number").alias("pos"), "d", F.col("tree").alias("of_tree"), F.col("height").alias("of_height"))
    out.top, last, above = _built(named, fanout, ["of_tree", "of_height"])
    out.root = last.first()["d"]
    out.height = max(height - 1, 0) + above
    out.root_name = (TOP, above, 0) if groups > 1 else (lambda r: (r["tree"], r["height"], 0))(out.subroots.first())
    return out


def _pointers(made: Manifest) -> DataFrame:
    """t, l, p (a node above the leaves, or a subroot), at, al, ap (its parent), segments (its siblings)."""
    parts = []
    for level, runs in enumerate(made.levels):
        if level:
            rows = _with_steps(runs.where("n > 1"))
            place = F.col("run") * made.fanout + F.col("x.i")
            parts.append(rows.select(F.col("tree").alias("t"), F.lit(level).alias("l"), place.alias("p"), F.col("tree").alias("at"), F.lit(level + 1).alias("al"), F.col("run").alias("ap"), F.array("step").alias("segments")))
    for level, runs in enumerate(made.top):
        rows = _with_steps(runs.where("n > 1"))
        if level:
            name = [F.lit(TOP).cast("long").alias("t"), F.lit(level).alias("l"), (F.col("run") * made.fanout + F.col("x.i")).alias("p")]
        else:
            name = [F.col("x.of_tree").alias("t"), F.col("x.of_height").alias("l"), F.lit(0).cast("long").alias("p")]
        parts.append(rows.select(*name, F.lit(TOP).cast("long").alias("at"), F.lit(level + 1).alias("al"), F.col("run").alias("ap"), F.array("step").alias("segments")))
    return reduce(DataFrame.unionByName, parts)


def jumped(made: Manifest) -> DataFrame:
    """t, l, p, segments up to the root, for every node just above the leaves and every lone leaf.

    Each round joins the nodes with the nodes their pointers name: the distance doubles, the segments are put
    together. A pointer at the root rests. Only inner nodes jump, a ``fanout``-th of the leaves; ancestors that many
    nodes share are few, and few are broadcast, so a hot ancestor is no hot key.
    """
    t, l, p = made.root_name
    paths, reach = stored(_pointers(made), "merkle-pointers"), 1
    at_root = (F.col("at") == t) & (F.col("al") == l) & (F.col("ap") == p)
    wanted = (F.col("t") != TOP) & (F.col("l") <= 1)
    while reach < made.height:
        last = reach * 2 >= made.height
        mine = paths.where(wanted) if last else paths
        above = paths.where((F.col("t") == TOP) | (F.col("l") > reach))
        small = above.count() <= JUMP_ROWS
        above = above.select(F.col("t").alias("jt"), F.col("l").alias("jl"), F.col("p").alias("jp"), F.struct("at", "al", "ap").alias("far"), F.col("segments").alias("more"))
        met = mine.where(~at_root).join(hinted(above, small), (F.col("at") == F.col("jt")) & (F.col("al") == F.col("jl")) & (F.col("ap") == F.col("jp")))
        met = met.select("t", "l", "p", "far.at", "far.al", "far.ap", F.concat("segments", "more").alias("segments"))
        paths, reach = stored(met.unionByName(mine.where(at_root)), "merkle-pointers"), reach * 2
    return paths.where(wanted).select("t", "l", "p", "segments")


def proofs(docs: DataFrame, leaf: Column, group: Column, order: dict[str, Column], keep: dict[str, Column] | None = None, fanout: int = 8) -> DataFrame:
    """One row per row of ``docs``: the columns of ``order`` and ``keep``, leaf, subroot, root, proof.

    ``leaf`` is each row's digest (see ``leaf_digest``). Inside a group (null is a group, the first) leaves ascend by the
    columns of ``order`` (null first), then digest; every ``fanout`` consecutive nodes become the digest of their digests until one is left, the
    subroot; the subroots in order of their groups give the root the same way. ``proof`` is an array of the
    siblings left and right of the path, 32 bytes a digest, from the leaf to the root; a run of one has an empty step.
    Repeated rows are leaves of their own. Whole texts are hashed where they are read and never shuffled, so very long ones cost no
    more. Names in ``docs`` cannot clash, since only the given expressions are read. An empty table gives no rows.
    """
    keep = keep or {}
    clash = {"leaf", "subroot", "root", "proof"} & {*order, *keep}
    if clash:
        raise ValueError(f"reserved names: {sorted(clash)}")
    named = {f"o_{k}": c for k, c in order.items()} | {f"k_{k}": c for k, c in keep.items()}
    leaves = docs.select(leaf.alias("leaf"), group.alias("g_group"), *[c.alias(k) for k, c in named.items()])
    made = build(leaves, "g_group", [f"o_{k}" for k in order], fanout)
    columns = [f"x.{name} as `{name[2:]}`" for name in named]
    if made.root is None:
        return _with_steps(made.levels[0]).selectExpr(*columns, "x.d as leaf", "x.d as subroot", "x.d as root", f"cast(array() as {SEGMENTS}) as proof")
    runs = made.levels[0].withColumn("l", F.when(F.col("n") == 1, 0).otherwise(1))
    if made.height:
        runs = _met(runs, jumped(made))
    else:
        runs = runs.withColumn("segments", F.lit(None).cast(SEGMENTS))
    subroots = broadcast_if_small(made.subroots.select(F.col("tree").alias("s_tree"), F.col("d").alias("subroot")))
    runs = runs.join(subroots, F.col("tree") == F.col("s_tree"))
    rest = F.coalesce("segments", F.array().cast(SEGMENTS))
    out = _with_steps(runs).withColumn("proof", F.when(F.col("n") == 1, rest).otherwise(F.concat(F.array("step"), rest)))
    return out.selectExpr(*columns, "x.d as leaf", "subroot", f"'{made.root}' as root", "proof")


def _met(runs: DataFrame, paths: DataFrame) -> DataFrame:
    """Runs of leaves with the segments above them; the run that is the root itself has none."""
    above = paths.select(F.col("t").alias("j_t"), F.col("l").alias("j_l"), F.col("p").alias("j_p"), "segments")
    return runs.join(above, (F.col("tree") == F.col("j_t")) & (F.col("l") == F.col("j_l")) & (F.col("run") == F.col("j_p")), "left").drop("j_t", "j_l", "j_p")
