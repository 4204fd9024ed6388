"""Near-duplicate vectors by an exact metric range join.

Unit vectors with a cosine of ``c`` or more lie within ``r = sqrt(2 - 2c)`` of each other. Pivots cut the vectors of a
label into cells; a vector's home is the cell of its nearest pivot. It is also sent to every cell that can hold a
partner: by the triangle inequality only where its distance to the pivot exceeds neither its distance to its own
pivot by more than ``2r`` nor the cell's radius by more than ``r``. So all partners of a vector meet it in its home
cell, and cells are joined independently, large ones as blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import pick, stage
from gridloom.operators.graph import component_labels

#: vectors per cell aimed at, vectors per block, and the most pivots (broadcast)
CELL, BLOCK, PIVOTS = 2048, 2048, 4096
SLACK = 1e-9


def linked(q, d, least: float):
    """Boolean matrix: cosine of each pair of rows in double precision, at least ``least``."""
    import numpy as np

    nq, nd = np.sqrt((q * q).sum(axis=1)), np.sqrt((d * d).sum(axis=1))
    cos = (q @ d.T) / (nq[:, None] * nd[None, :])
    mask = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):  # at the limit the order of additions decides
        mask[i, j] = float(np.dot(q[i], d[j])) / (float(nq[i]) * float(nd[j])) >= least
    return mask


def local_roots(n: int, a, b):
    """Smallest position reachable from each of ``n`` positions over pairs ``a, b``."""
    import numpy as np

    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def vector_links(vectors: DataFrame, least: float = 0.93, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared when their labels are equal and not null (and their lengths are equal) and linked at a cosine of
    ``least`` or more. A vector that is null, empty, zero or holds a null or non-finite component has no link. Equal
    vectors of a label are joined as one with a count; ``n_links`` counts all other rows. Rows with equal ids are
    rows of their own; a null id is the smallest only if all ids of the component are null.
    """
    if not 0 < least <= 1:
        raise ValueError("the cosine must lie in (0, 1]")
    import math

    spark = vectors.sparkSession
    source = pick(vectors, vec_id=id_column, v=vector, label=label).withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    node = F.when(sound, F.unhex(F.md5(F.concat_ws("|", F.col("label").cast("string"), F.to_json("v")))))
    rows = stage(source.withColumn("node", node).withColumn("grp", F.concat_ws("|", F.col("label").cast("string"), F.size("v").cast("string"))), "vectors")
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("lowest"), F.first("grp").alias("grp"), F.first("v").alias("v")
    )
    classes = stage(classes, "classes")
    total = classes.count()
    chosen = classes.orderBy(F.xxhash64("node"), "node").limit(min(PIVOTS, -(-total // CELL))).select("grp", "v").collect()
    pivots: dict[str, list] = {}
    for r in chosen:
        pivots.setdefault(r["grp"], []).append(r["v"])
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    shared = spark.sparkContext.broadcast(pivots)

    def distances(frame):
        """Rows of a group at a time: positions in the batch, and distances to the group's pivots."""
        import numpy as np

        for grp, part in frame.groupby("grp"):
            v = np.array(part["v"].tolist())
            v = v / np.sqrt((v * v).sum(axis=1))[:, None]
            p = np.array(shared.value.get(grp) or v[:1] * 0 + 1)
            p = p / np.sqrt((p * p).sum(axis=1))[:, None]
            yield grp, part, np.sqrt(np.maximum(2 - 2 * (v @ p.T), 0)) if grp in shared.value else np.zeros((len(v), 1))

    def homes(frames):
        for frame in frames:
            for _, part, d in distances(frame):
                yield part[["node", "grp", "v", "copies"]].assign(cell=d.argmin(axis=1), far=d.min(axis=1))

    home = stage(classes.mapInPandas(homes, "node binary, grp string, v array<double>, copies long, cell int, far double"), "homes")
    # only cells of groups with pivots have a radius to know: at most as many as there are pivots
    with_pivots = spark.createDataFrame([(g,) for g in pivots] or [("",)], "grp string")
    radii = {(r["grp"], r["cell"]): r["far"] for r in home.join(F.broadcast(with_pivots), "grp").groupBy("grp", "cell").agg(F.max("far").alias("far")).collect()}
    known = spark.sparkContext.broadcast(radii)

    def guests(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for grp, part, d in distances(frame):
                own = part["cell"].to_numpy()
                reach = np.array([known.value.get((grp, c), -1.0) for c in range(d.shape[1])])
                near = (d <= part["far"].to_numpy()[:, None] + 2 * radius + SLACK) & (d <= reach[None, :] + radius + SLACK) & (reach[None, :] >= 0)
                near[np.arange(len(own)), own] = False
                i, c = np.nonzero(near)
                yield pd.DataFrame({"node": part["node"].to_numpy()[i], "grp": grp, "v": part["v"].to_numpy()[i], "copies": part["copies"].to_numpy()[i], "cell": c})

    flat = "node binary, grp string, v array<double>, copies long, cell int"
    data = home.select("node", "grp", "v", "copies", "cell", F.lit(True).alias("own")).unionByName(
        home.mapInPandas(guests, flat).withColumn("own", F.lit(False))
    )
    data = stage(data, "cells")
    sizes = data.groupBy("grp", "cell").agg(
        F.ceil(F.count_if("own") / BLOCK).cast("int").alias("queries"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    sized = data.join(sizes, ["grp", "cell"])
    pos = F.xxhash64("node")
    asked = sized.where("own").select("grp", "cell", "node", "v", "copies", F.lit(True).alias("query"), F.pmod(pos, "queries").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    held = sized.select("grp", "cell", "node", "v", "copies", F.lit(False).alias("query"), F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("q"), F.pmod(pos, "blocks").alias("b"))

    def join_block(frame: "pd.DataFrame") -> "pd.DataFrame":  # noqa: F821
        import numpy as np
        import pandas as pd

        ask = frame["query"].to_numpy(bool)
        nodes, place = np.unique(np.array([x.hex() for x in frame["node"]], dtype="S"), return_inverse=True)
        v = np.array(frame["v"].tolist())
        q, d = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(q) or not len(d):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        mask = linked(v[q], v[d], least)
        mask &= place[q][:, None] != place[d][None, :]
        a, b = np.nonzero(mask)
        root = local_roots(len(nodes), place[q][a], place[d][b])
        name = {p: frame["node"].iloc[i] for i, p in enumerate(place)}
        links = np.zeros(len(nodes), dtype=np.int64)
        links[place[q]] = mask @ frame["copies"].to_numpy()[d]
        some = np.flatnonzero((links > 0) | (root != np.arange(len(nodes))))
        return pd.DataFrame({"node": [name[i] for i in some], "links": links[some], "root": [name[i] for i in root[some]]})

    join_block.__annotations__.clear()
    found = asked.unionByName(held).groupBy("grp", "cell", "q", "b").applyInPandas(join_block, "node binary, links long, root binary")
    found = stage(found, "links")
    labels = component_labels(found.where(F.col("node") != F.col("root")).select(F.col("node").alias("src"), F.col("root").alias("dst")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    table = classes.select("node", "copies", "lowest").join(counts, "node", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    table = table.withColumn("component", F.coalesce("component", "node"))
    lowest = table.groupBy("component").agg(F.min("lowest").alias("component_id"))
    per_node = table.join(lowest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return rows.select("vec_id", "node").join(per_node, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
