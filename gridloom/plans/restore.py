"""Reuse of earlier responses: which prompts are done, which are pending, what is copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = ["name", "parallelism_model", "prompt"]
COPIED = ["temperature", "top_p", "do_sample", "max_new_tokens", "outputs"]


def usable(responses: DataFrame, samples: int, temperature: float, prompted: bool | None = None, top_p: float | None = None) -> DataFrame:
    """Responses made with the same settings and holding the full number of samples."""
    keep = (F.size("outputs") == samples) & (F.col("temperature") == temperature)
    if prompted is not None:
        keep &= F.col("prompted") == prompted
    if top_p is not None:
        keep &= F.col("top_p") == top_p
    return responses.where(keep)


def without_response(prompts: DataFrame, responses: DataFrame, keys: list[str] = MATCH) -> DataFrame:
    """Prompts that no usable response covers."""
    return prompts.join(responses.select(*keys), keys, "left_anti")


def with_response(responses: DataFrame, prompts: DataFrame, keys: list[str] = MATCH) -> DataFrame:
    """Responses that belong to a current prompt."""
    return responses.join(prompts.select(*keys), keys, "left_semi")


def first_responses(responses: DataFrame, order: Column | str, keys: list[str] = MATCH) -> DataFrame:
    """The first response per key. min_by keeps one candidate per key and task; nothing is sorted."""
    fields = [c for c in responses.columns if c not in keys]
    return (
        responses.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_first")).select(*keys, "_first.*")
    )


def split_by_response(
    prompts: DataFrame, responses: DataFrame, order: str, keys: list[str] = MATCH
) -> tuple[DataFrame, DataFrame]:
    """(first matching response of each covered prompt, prompts left over)."""
    first = first_responses(responses, order, keys)
    return with_response(first, prompts, keys), without_response(prompts, first, keys)


def copy_outputs(prompts: DataFrame, responses: DataFrame, order: str, keys: list[str] = MATCH) -> DataFrame:
    """Prompts with the generation columns of their first matching response, null where there is none."""
    first = first_responses(responses, order, keys).select(*keys, *COPIED)
    return prompts.drop(*COPIED).join(first, keys, "left")


def repeat_samples(prompts: DataFrame, samples: int, out: str = "sample") -> DataFrame:
    """Every prompt once per wanted sample."""
    return prompts.withColumn(out, F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))) if samples > 0 else (
        prompts.withColumn(out, F.lit(0)).where(F.lit(False))
    )


def first_work(pending: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` items of pending work; Spark keeps only the top rows of each task."""
    return pending.orderBy(*order).limit(limit)


def all_responses(*parts: DataFrame) -> DataFrame:
    """Restored, cached and new responses in one table; columns that are absent become null."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def token_rates(log: DataFrame, keys: list[str], tokens: str = "tokens", seconds: str = "seconds") -> DataFrame:
    """Responses, total tokens and tokens per second of a generation log."""
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("responses"),
        F.sum(tokens).alias("total_tokens"),
        F.try_divide(F.sum(tokens), F.sum(seconds)).alias("tokens_per_second"),
    )
