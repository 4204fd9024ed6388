"""Prompt tables: lint, completeness, preparation, templates and translation prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.functions.rules import (
    CLEAN_MODEL_NAMES,
    FORBIDDEN,
    MODELS,
    NAME_SUFFIXES,
    REQUIRED,
    REQUIRED_EVERYWHERE,
    TRANSLATION_TEMPLATE,
    TRANSLATIONS,
)


def _lookup(values: dict, key: Column) -> Column:
    """Small fixed map as a CASE expression."""
    chain = None
    for name, value in values.items():
        chain = F.when(key == name, value) if chain is None else chain.when(key == name, value)
    return chain


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def violations(prompt: Column, model: Column) -> Column:
    """Array of broken rules; empty for a good prompt."""
    required = F.concat(_words(REQUIRED_EVERYWHERE), F.coalesce(_lookup({m: _words(w) for m, w in REQUIRED.items()}, model), _words([])))
    forbidden = F.coalesce(_lookup({m: _words(w) for m, w in FORBIDDEN.items()}, model), _words([]))
    missing = F.filter(required, lambda w: ~F.contains(prompt, w))
    present = F.filter(forbidden, lambda w: F.contains(prompt, w))
    return F.concat(
        F.array_compact(
            F.array(
                F.when(prompt == "", "empty"),
                F.when(~F.endswith(prompt, F.lit("{")), "does not end with {"),
                F.when(~model.isin(MODELS), "unknown model"),
            )
        ),
        F.transform(missing, lambda w: F.concat(F.lit("misses "), w)),
        F.transform(present, lambda w: F.concat(F.lit("contains "), w)),
    )


def lint(prompts: DataFrame) -> DataFrame:
    """Prompts with at least one violation."""
    checked = prompts.withColumn("violations", violations(F.col("prompt"), F.col("parallelism_model")))
    return checked.where(F.size("violations") > 0)


def require_valid(prompts: DataFrame) -> DataFrame:
    """The prompts unchanged; a job that meets an invalid one stops."""
    broken = violations(F.col("prompt"), F.col("parallelism_model"))
    message = F.concat(F.lit("invalid prompt "), F.col("name"), F.lit(": "), F.array_join(broken, ", "))
    return prompts.withColumn("prompt", F.when(F.size(broken) == 0, F.col("prompt")).otherwise(F.raise_error(message).cast("string")))


def incomplete_problems(prompts: DataFrame) -> DataFrame:
    """Problems whose set of models is not exactly the seven expected ones."""
    # one flag per model keeps the group state fixed in size; anything else counts as extra
    seen = [F.coalesce(F.bool_or(F.col("parallelism_model") == m), F.lit(False)) for m in MODELS]
    extra = F.coalesce(F.bool_or(~F.col("parallelism_model").isin(MODELS)), F.lit(False))
    missing = F.array_compact(F.array(*[F.when(~s, m) for s, m in zip(seen, MODELS)]))
    found = prompts.groupBy("problem_type", "name").agg(missing.alias("missing"), extra.alias("has_extra"))
    return found.where((F.size("missing") > 0) | F.col("has_extra"))


def prepare(prompts: DataFrame, function_suffix: str = "none", includes: bool = False) -> DataFrame:
    """Optionally rename the function per model ('model') or to a common suffix ('parallel'), and add includes."""
    prompt, model = F.col("prompt"), F.col("parallelism_model")
    if function_suffix == "model":
        prompt = text.suffix_function_name(prompt, _lookup({m: F.lit(s) for m, s in NAME_SUFFIXES.items()}, model))
    elif function_suffix == "parallel":
        prompt = text.suffix_function_name(prompt, F.lit("Parallel"))
    elif function_suffix != "none":
        raise ValueError(f"unknown function_suffix {function_suffix}")
    if includes:
        prompt = text.add_includes(prompt, model)
    return prompts.withColumn("prompt", prompt)


def first_correct(results: DataFrame) -> DataFrame:
    """(name, parallelism_model, code): first fully valid output, by file order, then position.

    ``results`` has one row per output: name, parallelism_model, source_file, output_idx,
    generated_output, are_all_valid. Only the smallest candidate per key leaves a map task.
    """
    good = results.where("are_all_valid")
    return good.groupBy("name", "parallelism_model").agg(
        F.min_by("generated_output", F.struct("source_file", "output_idx")).alias("code")
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def translation_prompts(prompts: DataFrame, results: DataFrame, tasks: list[tuple[str, str]] | None = None) -> DataFrame:
    """Prompts asking to translate a correct implementation in one model into another.

    ``tasks`` lists (source, target). Target prompts meet the source prompt of the same name and its
    first correct implementation; names without one drop out. The source prompt must be unique.
    """
    prompts_of = prompts.groupBy("name", "parallelism_model").agg(
        F.count(F.lit(1)).alias("_copies"), F.min("prompt").alias("_src_prompt")
    )
    pairs = F.array(
        *[F.struct(F.lit(s).alias("translation_src_model"), F.lit(d).alias("translation_dst_model")) for s, d in (tasks or TRANSLATIONS)]
    )
    targets = prompts.select("*", F.inline(pairs)).where(F.col("parallelism_model") == F.col("translation_dst_model"))
    source = prompts_of.withColumnRenamed("parallelism_model", "translation_src_model")
    code = first_correct(results).withColumnRenamed("parallelism_model", "translation_src_model")
    joined = targets.join(source, ["name", "translation_src_model"]).join(code, ["name", "translation_src_model"])
    one_source = F.when(F.col("_copies") == 1, F.col("_src_prompt")).otherwise(
        F.raise_error(F.concat(F.lit("more than one source prompt for "), F.col("name"))).cast("string")
    )
    clean = lambda model: _lookup({m: F.lit(n) for m, n in CLEAN_MODEL_NAMES.items()}, model)
    example = F.concat(one_source, F.lit("\n"), F.col("code"))
    name = text.function_name(F.col("prompt"), F.col("translation_dst_model"))
    filled = text.fill_slots(
        TRANSLATION_TEMPLATE,
        {
            "src_model": clean(F.col("translation_src_model")),
            "dst_model": clean(F.col("translation_dst_model")),
            "function_name": F.col("translation_function_name"),
            "dst_model_prompt": F.col("prompt"),
            "src_model_example": text.prefix_lines(F.col("translation_src_example"), "// "),
        },
    )
    return (
        joined.withColumn("translation_src_example", example)
        .withColumn("translation_function_name", name)
        .withColumn("translation_prompt", filled)
        .select(
            *prompts.columns, "translation_prompt", "translation_src_model", "translation_dst_model",
            "translation_src_example", "translation_function_name",
        )
    )
