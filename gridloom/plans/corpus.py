"""Which parallel programming models do source files use, by language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rules import CORPUS_LANGUAGES, CORPUS_MARKS


def uses(content: Column, lang: Column, marks: dict[str, list[str]]) -> Column:
    """True when the file has any of its language's marks. Plain substring tests, all in generated code;
    the language is tested first, so other files are never searched."""
    hit = F.lit(False)
    for name, needles in marks.items():
        any_needle = F.lit(False)
        for needle in needles:
            any_needle = any_needle | (F.contains(content, F.lit(needle)) if needle else F.lit(True))
        hit = F.when(lang == name, any_needle).otherwise(hit)
    return hit


def model_flags(content: Column, lang: Column, rules: dict[str, dict[str, list[str]]] = CORPUS_MARKS) -> dict[str, Column]:
    return {model: uses(content, lang, marks) for model, marks in rules.items()}


def usage_by_language(
    files: DataFrame, content: str = "content", lang: str = "lang", rules: dict[str, dict[str, list[str]]] = CORPUS_MARKS
) -> DataFrame:
    """(lang, files, one count per model). Works on batch and streaming frames alike."""
    flags = model_flags(F.col(content), F.col(lang), rules)
    return files.groupBy(F.col(lang).alias("lang")).agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(flag).alias(model) for model, flag in flags.items()]
    )


def usage_totals(by_language: DataFrame) -> DataFrame:
    """One row: files of all languages, and files per model."""
    models = [c for c in by_language.columns if c not in ("lang", "files")]
    return by_language.agg(F.sum("files").alias("total"), *[F.sum(m).alias(m) for m in models])


def covered_languages(rules: dict[str, dict[str, list[str]]] = CORPUS_MARKS) -> list[str]:
    """Languages with rules; files in any other language only count towards the totals."""
    named = {name for marks in rules.values() for name in marks}
    return [name for name in CORPUS_LANGUAGES if name in named] if rules is CORPUS_MARKS else sorted(named)
