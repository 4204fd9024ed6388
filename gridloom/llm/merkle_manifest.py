"""Merkle manifest of a table: one digest per group, one over all groups, and an inclusion proof for every row.

The rank of a leaf within its group is written in digits of base ``arity``. The digits are grouped away one after
another, the lowest first, inside blocks of ``arity ** LEVELS`` leaves: every group nests its children's structs and
adds their digest, so a block becomes one row of bounded size after a single shuffle. The blocks' digests are leaves
of the next round, until a group has one block left. On the way back the steps above a block meet its row in an
aggregate, and ``transform`` and ``explode`` turn the nested row into the proofs of its leaves, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stage
from gridloom.operators.index import rank_rows

#: children of a node, and digits that are grouped away within a block (243 leaves)
ARITY, LEVELS = 3, 5
STEPS = "array<struct<left:string,right:string>>"


def field(column: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, ``:`` and the value."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the inputs' concatenation; digests go in as hex text."""
    return F.sha2(F.concat(*parts), 256)


def roll_up(nodes: DataFrame, keys: list[str], arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``keys, rank, digest, payload`` -> ``keys, block, digest, hashed, kids``, a row for each block of ``arity ** levels`` ranks.

    A node is hashed unless it is the only one left in its group: that is the node of rank 0 without a neighbour.
    """
    size = arity**levels
    digits = [f"_d{level}" for level in range(levels)]
    place = [(F.call_function("div", F.col("rank"), F.lit(arity**k)) % arity).cast("tinyint").alias(d) for k, d in enumerate(digits)]
    rows = nodes.select(*keys, F.call_function("div", F.col("rank"), F.lit(size)).alias("block"), *place, "digest", "payload")
    rows = rows.repartition(*keys, "block")  # every grouping below keeps to it
    fields = ["digest", "payload"]
    for k, low in enumerate(digits):
        high = digits[k + 1 :]
        rows = rows.groupBy(*keys, "block", *high).agg(F.array_sort(F.collect_list(F.struct(low, *fields))).alias("kids"))
        first = F.col("block") == 0
        for d in high:
            first = first & (F.col(d) == 0)
        joined = F.array_join(F.transform("kids", lambda kid: kid["digest"]), "")
        rows = rows.withColumn("hashed", ~(first & (F.size("kids") == 1)))
        rows = rows.withColumn("digest", F.when(F.col("hashed"), digest(joined)).otherwise(F.col("kids")[0]["digest"]))
        fields = ["digest", "hashed", "kids"]
    return rows.select(*keys, "block", *fields)


def roll_up_all(nodes: DataFrame, keys: list[str], arity: int = ARITY, levels: int = LEVELS) -> list[DataFrame]:
    """Staged tables of blocks, from the leaves up; in the last one each group is one block."""
    tables = []
    while True:
        tables.append(stage(roll_up(nodes, keys, arity, levels), "blocks"))
        if not tables[-1].agg(F.max("block")).first()[0]:
            return tables
        nodes = tables[-1].select(*keys, F.col("block").alias("rank"), "digest", F.lit(None).cast("int").alias("payload"))


def _leaves(hashed: Column, kids: Column, above: Column, levels: int) -> Column:
    """Leaves below a node with the steps from each of them up to the block's top, the lowest first."""

    def texts(nodes: Column) -> Column:
        return F.array_join(F.transform(nodes, lambda node: node["digest"]), "")

    def of(kid: Column, i: Column) -> Column:
        step = F.struct(texts(F.slice(kids, 1, i)).alias("left"), texts(F.slice(kids, i + 2, F.size(kids))).alias("right"))
        steps = F.concat(F.when(hashed, F.array(step)).otherwise(F.array().cast(STEPS)), above)
        if levels > 1:
            return _leaves(kid["hashed"], kid["kids"], steps, levels - 1)
        return F.struct(kid["digest"].alias("digest"), kid["payload"].alias("payload"), steps.alias("steps"))

    leaves = F.transform(kids, of)
    return F.flatten(leaves) if levels > 1 else leaves


def hand_down(tables: list[DataFrame], keys: list[str], tops: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``keys, rank, digest, payload, steps, above`` of all leaves. ``tops`` has ``keys, steps, above`` of each group's top."""
    outer = tops.select(*keys, F.lit(0).cast("bigint").alias("block"), "steps", "above")
    for table in reversed(tables):
        # exactly one row of either side for each block
        met = table.select(*keys, "block", "hashed", "kids").unionByName(outer, allowMissingColumns=True).groupBy(*keys, "block")
        met = met.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("hashed", "kids", "steps", "above")])
        found = met.select(*keys, "block", "above", F.posexplode(_leaves(F.col("hashed"), F.col("kids"), F.col("steps"), levels)).alias("_place", "_leaf"))
        rank = (F.col("block") * arity**levels + F.col("_place")).alias("rank")
        leaves = found.select(*keys, rank, "_leaf.*", "above")
        outer = leaves.select(*keys, F.col("rank").alias("block"), "steps", "above")
    return leaves


def manifest(
    docs: DataFrame, fields: list[str], forged: Column | None = None, group: str = "source", id_column: str = "doc_id", text: str = "text",
    arity: int = ARITY, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof, folded_root``.

    A leaf is the digest of ``fields``; leaves of a group stand in the order of their ids, a null id first, equal
    ids in the order of their leaves. Runs of ``arity`` become a node until one is left, the group's subroot; the
    subroots, a null group first, else by bytes, likewise become the root. ``proof`` lists per level what stands
    ``left`` and ``right`` of the path, from the leaf to the root. ``folded_root`` is the root that follows from the proof
    and the leaf of the row with ``forged`` as its text (null or none given: the leaf itself), as a verifier would
    compute it. Equal rows are leaves of their own. A null is a value of its own in every field. An empty table has no rows.
    """
    names = {f"f{k}": c for k, c in enumerate(fields)}
    spoilt = [] if forged is None else [forged.alias("spoilt")]
    own = {"doc_id": id_column, "grp": group, **names}
    rows = docs.select(*[docs[f"`{old}`"].alias(new) for new, old in own.items()], *spoilt)
    leaf = digest(*[field(F.col(f)) for f in names])
    other = F.lit(None).cast("string")
    if forged is not None:
        parts = [field(F.coalesce(F.col("spoilt"), F.col(f)) if c == text else F.col(f)) for f, c in names.items()]
        other = F.when(F.col("spoilt").isNotNull(), digest(*parts))
    # the number of the row tells equal rows apart, so that ranges can split any number of them
    leaves = rows.select("grp", "doc_id", leaf.alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = stage(leaves, "leaves")
    ranked = rank_rows(leaves, ["doc_id", "digest", "row"], "rank", ["grp"])
    blocks = roll_up_all(ranked.select("grp", "rank", "digest", F.struct("doc_id", "other").alias("payload")), ["grp"], arity, levels)

    groups = rank_rows(blocks[-1].select("grp", "digest"), ["grp"], "rank")
    everything = F.lit(0).alias("all")
    upper = roll_up_all(groups.select(everything, "rank", "digest", F.struct("grp").alias("payload")), ["all"], arity, levels)
    none = F.array().cast(STEPS).alias("steps")
    subroots = hand_down(upper, ["all"], upper[-1].select("all", none, F.col("digest").alias("above")), arity, levels)
    tops = subroots.select("payload.grp", "steps", F.struct(F.col("digest").alias("subroot"), F.col("above").alias("root")).alias("above"))
    found = hand_down(blocks, ["grp"], tops, arity, levels)
    folded = F.aggregate(
        "steps", F.coalesce(F.col("payload.other"), F.col("digest")), lambda node, step: digest(step["left"], node, step["right"])
    )
    return found.select(
        F.col("payload.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "above.subroot", "above.root",
        F.col("steps").alias("proof"), folded.alias("folded_root"),
    )


def siblings(proof: str) -> Column:
    """All digests of a proof as one text, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")
