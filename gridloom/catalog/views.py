"""Views of the shared tables as vectors, points, matrices, graphs, grids and series.

Every Spark view stands next to the SQL text that defines the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.catalog.registry import Tables
from gridloom.operators.index import ordinal


def vec(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("i"), F.col("value").alias("x"))


VEC = "vec AS (SELECT event_id AS i, value AS x FROM events)"


def dvec(t: Tables) -> DataFrame:
    return vec(t).withColumn("x", F.col("x").cast("decimal(18,2)"))


DVEC = "dvec AS (SELECT event_id AS i, CAST(value AS DECIMAL(18,2)) AS x FROM events)"


def ivec(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("i"), (F.col("value").cast("bigint") - 50).alias("x"))


IVEC = "ivec AS (SELECT event_id AS i, CAST(trunc(value) AS BIGINT) - 50 AS x FROM events)"


def ovec(t: Tables) -> DataFrame:
    """Order prices by position, to pair with ``dvec``."""
    return t.orders.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))


OVEC = "ovec AS (SELECT o_orderkey AS i, CAST(o_totalprice AS DECIMAL(18,2)) AS x FROM orders)"


def oivec(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1000).cast("bigint").alias("x"))


OIVEC = "oivec AS (SELECT o_orderkey AS i, CAST(trunc(o_totalprice / 1000) AS BIGINT) AS x FROM orders)"


def qpts(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("i"), (F.col("user_id") - 75).cast("double").alias("x"), (F.col("value") - 50).alias("y")
    )


QPTS = "qpts AS (SELECT event_id AS i, CAST(user_id - 75 AS DOUBLE) AS x, value - 50 AS y FROM events)"


def pts(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select(F.col("vec_id").alias("i"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), "label")


PTS = (
    "pts AS (SELECT vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"
)


def opts(t: Tables) -> DataFrame:
    """Orders as points (price, day)."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return t.orders.select(F.col("o_orderkey").alias("i"), F.col("o_totalprice").alias("x"), day.cast("double").alias("y"))


OPTS = (
    "opts AS (SELECT o_orderkey AS i, o_totalprice AS x,"
    " CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y FROM orders)"
)


def order_parts(t: Tables) -> DataFrame:
    """Sparse order x part matrix of quantities; a coordinate may repeat."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("decimal(18,2)").alias("value")
    )


ORDER_PARTS = (
    "order_parts AS (SELECT l_orderkey AS \"row\", l_partkey AS col, CAST(l_quantity AS DECIMAL(18,2)) AS value FROM lineitem)"
)


def part_prices(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("i"), F.col("p_retailprice").cast("decimal(18,2)").alias("x"))


PART_PRICES = "part_prices AS (SELECT p_partkey AS i, CAST(p_retailprice AS DECIMAL(18,2)) AS x FROM part)"


def supplier_parts(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("decimal(18,2)").alias("value")
    )


SUPPLIER_PARTS = (
    "supplier_parts AS (SELECT l_suppkey AS \"row\", l_partkey AS col, CAST(l_quantity AS DECIMAL(18,2)) AS value FROM lineitem)"
)


def part_lines(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_partkey").alias("row"),
        F.col("l_linenumber").cast("bigint").alias("col"),
        F.col("l_discount").cast("decimal(18,2)").alias("value"),
    )


PART_LINES = (
    "part_lines AS (SELECT l_partkey AS \"row\", CAST(l_linenumber AS BIGINT) AS col,"
    " CAST(l_discount AS DECIMAL(18,2)) AS value FROM lineitem)"
)


def embedding_cells(t: Tables) -> DataFrame:
    """Embeddings as a dense matrix: one row per vector, one column per dimension."""
    cells = t.embeddings.select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "value"))
    return cells.select("row", F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value"))


EMBEDDING_CELLS = (
    "embedding_cells AS (SELECT vec_id AS \"row\", d - 1 AS col, CAST(embedding[d] AS DOUBLE) AS value"
    " FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings))"
)


def trade(t: Tables) -> DataFrame:
    """Customer-supplier pairs with their number of order lines; suppliers have negative ids."""
    lines = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.groupBy(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).agg(F.count(F.lit(1)).alias("a"))


TRADE = (
    "trade AS (SELECT o_custkey AS src, -1 - l_suppkey AS dst, count(*) AS a FROM orders"
    " JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
)


def traders(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).union(t.supplier.select(-1 - F.col("s_suppkey")))


TRADERS = "traders AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT -1 - s_suppkey FROM supplier)"


def purchases(t: Tables) -> DataFrame:
    """Customer-order links; orders have negative ids. A forest of stars."""
    return t.orders.select(F.col("o_custkey").alias("src"), (-1 - F.col("o_orderkey")).alias("dst"))


PURCHASES = "purchases AS (SELECT o_custkey AS src, -1 - o_orderkey AS dst FROM orders)"


def buyers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id")).union(t.orders.select(-1 - F.col("o_orderkey")))


BUYERS = "buyers AS (SELECT c_custkey AS id FROM customer UNION ALL SELECT -1 - o_orderkey FROM orders)"


def grid(t: Tables) -> DataFrame:
    """Events laid out row by row, 100 per row."""
    return t.events.select(
        F.expr("event_id div 100").alias("r"), (F.col("event_id") % 100).alias("c"), (F.col("value").cast("bigint") % 256).alias("v")
    )


GRID = "grid AS (SELECT event_id // 100 AS r, event_id % 100 AS c, CAST(trunc(value) AS BIGINT) % 256 AS v FROM events)"


def bit_grid(t: Tables) -> DataFrame:
    return grid(t).withColumn("v", F.col("v") % 2)


BIT_GRID = GRID + ", bit_grid AS (SELECT r, c, v % 2 AS v FROM grid)"


def series(t: Tables) -> DataFrame:
    """One complex series per user: values and hours in event order."""
    events = t.events.select("user_id", "event_id", F.col("value").alias("re"), F.hour("ts").cast("double").alias("im"))
    return ordinal(events, "event_id", "n", ["user_id"]).drop("event_id")


SERIES = (
    "series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, value AS re,"
    " CAST(extract('hour' FROM ts) AS DOUBLE) AS im FROM events)"
)


def price_fit(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Per supplier: normal equations of line price on (1, quantity, discount)."""
    from gridloom.operators.matrix import gram

    exact = lambda c: F.col(c).cast("decimal(12,2)")
    columns = {"one": F.lit(1).cast("decimal(12,2)"), "quantity": exact("l_quantity"), "discount": exact("l_discount")}
    a, b = gram(t.lineitem, ["l_suppkey"], columns, exact("l_extendedprice"))
    return a.withColumnRenamed("l_suppkey", "system_id"), b.withColumnRenamed("l_suppkey", "system_id")


PRICE_FIT = """
lines AS (SELECT l_suppkey AS system_id, CAST(l_quantity AS DECIMAL(12,2)) AS q, CAST(l_discount AS DECIMAL(12,2)) AS d,
                 CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem),
sums AS (SELECT system_id, CAST(count(*) AS DOUBLE) AS a00, CAST(sum(q) AS DOUBLE) AS a01, CAST(sum(d) AS DOUBLE) AS a02,
                CAST(sum(q*q) AS DOUBLE) AS a11, CAST(sum(q*d) AS DOUBLE) AS a12, CAST(sum(d*d) AS DOUBLE) AS a22,
                CAST(sum(p) AS DOUBLE) AS b0, CAST(sum(q*p) AS DOUBLE) AS b1, CAST(sum(d*p) AS DOUBLE) AS b2
         FROM lines GROUP BY system_id),
step1 AS (SELECT *, a01/a00 AS l10, a02/a00 AS l20 FROM sums),
step2 AS (SELECT *, a11 - l10*a01 AS u11, a12 - l10*a02 AS u12, a12 - l20*a01 AS m21, a22 - l20*a02 AS m22,
                 b1 - l10*b0 AS c1, b2 - l20*b0 AS c2 FROM step1),
step3 AS (SELECT *, m21/u11 AS l21 FROM step2),
step4 AS (SELECT *, m22 - l21*u12 AS u22, c2 - l21*c1 AS e2 FROM step3)"""


# ---- evaluation results played by documents and labels

NAMED_MODELS = {"en": "omp", "fr": "mpi", "de": "kokkos", "es": "mpi+omp"}


def runs(t: Tables) -> DataFrame:
    """Flat runs. A document is one output, its source the problem. Documents without a label never built;
    the others ran once per resource setting of their model."""
    kind = F.expr(
        "CASE n_chars % 7 WHEN 0 THEN 'serial' WHEN 1 THEN 'cuda' ELSE"
        " CASE lang WHEN 'en' THEN 'omp' WHEN 'fr' THEN 'mpi' WHEN 'de' THEN 'kokkos' ELSE 'mpi+omp' END END"
    )
    outputs = t.documents.join(t.labels, "doc_id", "left").select(
        F.col("source").alias("name"),
        kind.alias("parallelism_model"),
        F.concat(F.lit("type"), (F.substr("source", F.lit(4)).cast("bigint") % 4).cast("string")).alias("problem_type"),
        F.col("doc_id").alias("output_idx"),
        F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("did_build"),
        (F.col("quality") == 1).alias("good"),
        "n_chars",
    )
    settings = F.expr(
        "CASE WHEN NOT did_build THEN NULL"
        " WHEN parallelism_model IN ('omp', 'kokkos') THEN array(0, 1, 2, 3, 4, 5, 6)"
        " WHEN parallelism_model = 'mpi' THEN array(0, 3, 6, 9)"
        " WHEN parallelism_model = 'mpi+omp' THEN array(0, 1, 2) ELSE array(0) END"
    )
    rows = outputs.select("*", F.posexplode_outer(settings).alias("run_idx", "p"))
    threads = F.expr(
        "CASE WHEN parallelism_model IN ('omp', 'kokkos') THEN shiftleft(1, p) WHEN parallelism_model = 'mpi+omp' THEN 64 END"
    )
    procs = F.expr(
        "CASE WHEN parallelism_model = 'mpi' THEN shiftleft(1, p) WHEN parallelism_model = 'mpi+omp' THEN shiftleft(1, p) END"
    )
    ran = F.col("run_idx").isNotNull()
    return rows.select(
        "name", "parallelism_model", "problem_type", "output_idx", "did_build", "run_idx",
        F.when(ran, True).alias("did_run"),
        F.when(ran, F.col("good") & ((F.col("output_idx") + F.col("run_idx")) % 11 != 0)).alias("is_valid"),
        F.when(ran, F.col("n_chars") / (F.col("p") + 1)).alias("runtime"),
        F.when(ran, F.col("n_chars") * 2.0).alias("best_sequential_runtime"),
        F.when(ran, threads).alias("num_threads"),
        F.when(ran, procs).alias("num_procs"),
    )


RUNS = """
outs AS (SELECT source AS name, CASE n_chars % 7 WHEN 0 THEN 'serial' WHEN 1 THEN 'cuda' ELSE
                CASE lang WHEN 'en' THEN 'omp' WHEN 'fr' THEN 'mpi' WHEN 'de' THEN 'kokkos' ELSE 'mpi+omp' END END AS parallelism_model,
                'type' || CAST(CAST(substr(source, 4) AS BIGINT) % 4 AS VARCHAR) AS problem_type, d.doc_id AS output_idx,
                coalesce(toxic = 0, false) AS did_build, quality = 1 AS good, n_chars
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
settings AS (SELECT *, CASE WHEN parallelism_model IN ('omp', 'kokkos') THEN [0, 1, 2, 3, 4, 5, 6]
                            WHEN parallelism_model = 'mpi' THEN [0, 3, 6, 9]
                            WHEN parallelism_model = 'mpi+omp' THEN [0, 1, 2] ELSE [0] END AS ps FROM outs),
runs AS (SELECT name, parallelism_model, problem_type, output_idx, did_build, NULL AS run_idx, NULL AS did_run, NULL AS is_valid,
                NULL AS runtime, NULL AS best_sequential_runtime, NULL AS num_threads, NULL AS num_procs FROM settings WHERE NOT did_build
         UNION ALL
         SELECT name, parallelism_model, problem_type, output_idx, did_build, ix - 1, true, good AND (output_idx + ix - 1) % 11 <> 0,
                n_chars / (ps[ix] + 1), n_chars * 2.0,
                CASE WHEN parallelism_model IN ('omp', 'kokkos') THEN 1 << ps[ix] WHEN parallelism_model = 'mpi+omp' THEN 64 END,
                CASE WHEN parallelism_model IN ('mpi', 'mpi+omp') THEN 1 << ps[ix] END
         FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS ix FROM settings WHERE did_build))"""


def problem_sizes(t: Tables) -> DataFrame:
    """A size per (source, model), as text."""
    sources = t.documents.select(F.col("source").alias("name")).distinct()
    models = F.explode(F.array(*[F.lit(m) for m in ("serial", "omp", "cuda", "kokkos")]))
    bits = (F.substr("name", F.lit(4)).cast("bigint") % 10 + 5).cast("string")
    return sources.select("name", models.alias("parallelism_model"), F.concat(F.lit("(1<<"), bits, F.lit(")")).alias("problem_size"))


CLEAN_RUNS = RUNS + """,
clean AS (SELECT r.* EXCLUDE (did_run, is_valid), coalesce(did_run, false) AS did_run, coalesce(is_valid, false) AS is_valid,
                 CASE WHEN parallelism_model IN ('serial', 'omp', 'cuda', 'kokkos')
                      THEN 1 << (CAST(substr(name, 4) AS BIGINT) % 10 + 5) END AS problem_size
          FROM runs r WHERE NOT coalesce(parallelism_model = 'kokkos' AND num_threads = 64, false))"""


def clean_runs(t: Tables) -> DataFrame:
    from gridloom.plans.ingest import clean_runs as clean
    from gridloom.plans.ingest import with_problem_size

    return clean(with_problem_size(runs(t), problem_sizes(t)))


def completions(t: Tables) -> DataFrame:
    """Generated code played by whole documents: full stops close and commas open a brace."""
    header = F.concat(F.lit("/* "), F.col("source"), F.lit(" */\nvoid f"), F.col("doc_id"), F.lit("(int x) {"))
    code = F.translate("text", ".,", "}{")
    return t.documents.select(
        "doc_id", "lang", "source", header.alias("prompt"), code.alias("code"), F.concat(F.lit("// "), F.col("lang"), F.lit("\n"), header, code).alias("output")
    )


COMPLETIONS = (
    "completions AS (SELECT doc_id, lang, source, '/* ' || source || ' */' || chr(10) || 'void f' || doc_id || '(int x) {' AS prompt,"
    " translate(text, '.,', '}{') AS code FROM documents)"
)


def sources_in_languages(t: Tables) -> DataFrame:
    """Source files played by documents: some words become marks of programming models."""
    language = F.expr("CASE lang WHEN 'en' THEN 'C' WHEN 'fr' THEN 'C++' WHEN 'de' THEN 'FORTRAN' ELSE 'Java' END")
    marked = F.expr("replace(replace(replace(text, 'able', 'MPI_'), 'que', '#pragma omp'), 'eau', 'Kokkos::')")
    return t.documents.select(marked.alias("content"), language.alias("lang"))


SOURCES_IN_LANGUAGES = (
    "files AS (SELECT replace(replace(replace(text, 'able', 'MPI_'), 'que', '#pragma omp'), 'eau', 'Kokkos::') AS content,"
    " CASE lang WHEN 'en' THEN 'C' WHEN 'fr' THEN 'C++' WHEN 'de' THEN 'FORTRAN' ELSE 'Java' END AS lang FROM documents)"
)
