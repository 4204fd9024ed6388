"""Readers and writers for prompts, nested results, flat runs and caches, with explicit schemas."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.prompt_tree import read_prompt_tree  # noqa: F401

STRING, BOOLEAN, DOUBLE, INT = T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RUN = _schema(did_run=BOOLEAN, is_valid=BOOLEAN, runtime=DOUBLE, num_threads=INT, num_procs=INT)

OUTPUT = _schema(
    generated_output=STRING,
    source_write_success=BOOLEAN,
    did_build=BOOLEAN,
    is_source_valid=BOOLEAN,
    did_any_run=BOOLEAN,
    did_all_run=BOOLEAN,
    are_any_valid=BOOLEAN,
    are_all_valid=BOOLEAN,
    best_sequential_runtime=DOUBLE,
    runs=T.ArrayType(RUN),
)

PROMPT = _schema(problem_type=STRING, language=STRING, name=STRING, parallelism_model=STRING, prompt=STRING)

# outputs are text before evaluation and objects after it; both arrive as text
RESULTS = T.StructType(
    [
        *PROMPT.fields,
        *_schema(
            temperature=DOUBLE,
            top_p=DOUBLE,
            do_sample=BOOLEAN,
            max_new_tokens=INT,
            prompted=BOOLEAN,
            outputs=T.ArrayType(STRING),
        ).fields,
    ]
)

FLAT_RUNS = T.StructType(
    [
        *_schema(prompt=STRING, name=STRING, problem_type=STRING, language=STRING, parallelism_model=STRING).fields,
        *_schema(temperature=DOUBLE, top_p=DOUBLE, do_sample=BOOLEAN, max_new_tokens=INT, prompted=BOOLEAN).fields,
        *_schema(generated_output=STRING, did_build=BOOLEAN, is_source_valid=BOOLEAN).fields,
        *_schema(best_sequential_runtime=DOUBLE, output_idx=INT, run_idx=INT).fields,
        *RUN.fields,
    ]
)


def read_results(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType = RESULTS) -> DataFrame:
    """Prompt records with their outputs. Use JSON lines (``lines=True``) for large data: a single
    JSON array per file is read by one task per file."""
    reader = spark.read.schema(schema)
    return (reader if lines else reader.option("multiLine", True)).json(path)


def read_ranked_results(spark: SparkSession, pattern: str, lines: bool = False) -> DataFrame:
    """Results of all files or folders that match ``pattern``, with ``source_file`` and its 0-based ``source_rank`` by name.

    A folder that matches counts as one file, whatever its parts. The names come from the listing, so ranks take no scan.
    """
    rows = read_results(spark, pattern, lines)
    depth = _path_only(pattern).rstrip("/").count("/")
    names = {"/".join(_path_only(unquote(f)).split("/")[: depth + 1]) for f in rows.inputFiles()}
    ranks = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(names))], "source_file string, source_rank int")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    source = F.substring_index(F.regexp_replace(path, _SCHEME, "/"), "/", depth + 1)
    return rows.select("*", source.alias("source_file")).join(ranks, "source_file")


#: scheme and host of a path
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/+"


def _path_only(path: str) -> str:
    return re.sub(_SCHEME, "/", path)


def parse_outputs(outputs: Column) -> Column:
    """array<string> -> array<struct>; plain text outputs become null structs."""
    return F.transform(outputs, lambda o: F.when(F.startswith(o, F.lit("{")), F.from_json(o, OUTPUT)))


def read_problem_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``{problem: {model: "(1<<n)"}}`` as (name, parallelism_model, problem_size)."""
    nested = spark.read.text(path, wholetext=True)
    sizes = F.from_json("value", "map<string,map<string,string>>")
    return (
        nested.select(F.explode(sizes).alias("name", "_by_model"))
        .select("name", F.explode("_by_model").alias("parallelism_model", "problem_size"))
    )


def read_launch_params(spark: SparkSession, path: str) -> DataFrame:
    """``{model: {format, params}}`` as one row per model and launch setting."""
    nested = spark.read.text(path, wholetext=True)
    shape = "map<string,struct<format:string,params:array<struct<num_threads:int,num_procs:int>>>>"
    models = nested.select(F.explode(F.from_json("value", shape)).alias("parallelism_model", "_launch"))
    return models.select(
        "parallelism_model", F.col("_launch.format").alias("format"), F.posexplode("_launch.params").alias("run_idx", "_p")
    ).select("parallelism_model", "format", "run_idx", "_p.num_threads", "_p.num_procs")


def escape_newlines(df: DataFrame, columns: tuple[str, ...] = ("prompt", "generated_output")) -> DataFrame:
    return df.withColumns({c: F.replace(F.col(c), F.lit("\n"), F.lit("\\n")) for c in columns})


def write_flat_csv(runs: DataFrame, path: str) -> None:
    """Flat runs as CSV parts, one header each, text columns on one line."""
    escape_newlines(runs).write.option("header", True).option("escape", '"').csv(path)


def read_flat_csv(spark: SparkSession, path: str, schema: T.StructType = FLAT_RUNS) -> DataFrame:
    # newlines are escaped by the writer, so files stay splittable; multiLine would read each whole
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def write_runs(runs: DataFrame, path: str) -> None:
    """Flat runs at rest: Parquet by execution model, so the metric filters prune whole folders."""
    runs.write.partitionBy("parallelism_model").parquet(path)


def write_table(df: DataFrame, path: str | None = None) -> None:
    """Metric tables: CSV if a path is given, else every row to the console, one partition at a time."""
    if path:
        df.write.option("header", True).csv(path)
    else:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))


def append_cache(df: DataFrame, path: str) -> None:
    """Append responses to a JSON Lines cache."""
    df.write.mode("append").json(path)


def read_cache(spark: SparkSession, path: str, schema: T.StructType = RESULTS) -> DataFrame:
    return spark.read.schema(schema).json(path)
