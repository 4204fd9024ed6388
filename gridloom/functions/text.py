"""Text functions as Column expressions: no Python is called per row.

Bracket matching splits the text at closing brackets and folds over the pieces, so its cost is in
the number of brackets, not characters. Where a value cannot be derived the result is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rules import CPU_HEADER, GPU_HEADER, INCLUDES, PROMPT_STYLES, SUFFIX_HEADER, WHITESPACE

LINE_BREAK = r"\r\n|\n|\r"


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITESPACE))


def rstrip(s: Column) -> Column:
    return F.rtrim(s, F.lit(WHITESPACE))


def last_line(s: Column) -> Column:
    """Last line; one trailing line break does not open another line."""
    return F.element_at(F.split(F.regexp_replace(s, rf"({LINE_BREAK})\z", ""), LINE_BREAK), -1)


def remove_prefix(s: Column, prefix: Column) -> Column:
    return F.when(F.startswith(s, prefix), F.substr(s, F.length(prefix) + 1)).otherwise(s)


def remove_suffix(s: Column, suffix: Column) -> Column:
    return F.when(F.endswith(s, suffix), F.substr(s, F.lit(1), F.length(s) - F.length(suffix))).otherwise(s)


def after_first(s: Column, mark: Column) -> Column:
    """Text after the first occurrence of ``mark``; null if it does not occur."""
    at = F.position(mark, s)
    return F.when(at > 0, F.substr(s, at + F.length(mark)))


def occurrences(s: Column, single: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(single), F.lit("")))


def _closed_pieces(s: Column, right: str) -> tuple[Column, Column]:
    """Pieces that end at a closing bracket, and the rest after the last one."""
    pieces = F.split(s, rf"\Q{right}\E", -1)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.element_at(pieces, -1)


def closing_position(s: Column, left: str = "{", right: str = "}") -> Column:
    """1-based position of the bracket that closes one opened just before ``s``; null if unclosed."""
    pieces, _ = _closed_pieces(s, right)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("cut"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + occurrences(piece, left) - 1
        read = acc["read"] + F.length(piece) + 1
        return F.struct(
            depth.alias("depth"), read.alias("read"), F.coalesce(acc["cut"], F.when(depth == 0, read)).alias("cut")
        )

    return F.aggregate(pieces, start, step, lambda acc: acc["cut"])


def balanced(s: Column, left: str = "{", right: str = "}") -> Column:
    """True when every bracket is closed and none is closed before it was opened."""
    pieces, rest = _closed_pieces(s, right)
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + occurrences(piece, left) - 1
        return F.struct(depth.alias("depth"), (acc["ok"] & (depth >= 0)).alias("ok"))

    folded = F.aggregate(pieces, start, step)
    return folded["ok"] & (folded["depth"] + occurrences(rest, left) == 0)


def function_name(prompt: Column, model: Column) -> Column:
    """Name in the function header on the last line; null if there is none."""
    header = last_line(prompt)
    gpu = F.regexp_extract(header, GPU_HEADER, 1)
    cpu = F.regexp_extract(header, CPU_HEADER, 1)
    return F.nullif(F.when(model.isin("cuda", "hip"), gpu).otherwise(cpu), F.lit(""))


def header_name(prompt: Column) -> Column:
    """As ``function_name``, the kind of header told from the prompt itself."""
    return function_name(prompt, F.when(F.contains(prompt, F.lit("__global__")), F.lit("cuda")).otherwise(F.lit("serial")))


def clean_completion(output: Column, prompt: Column) -> Column:
    """Body of a completion: after the prompt, up to the brace that closes the function.

    Everything is kept when the brace is missing; null when the prompt is not in the output.
    """
    body = strip(after_first(output, prompt))
    cut = closing_position(body)
    return F.when(cut.isNull(), body).otherwise(F.substr(body, F.lit(1), cut))


def clean_completions(df: DataFrame, output: str, prompt: str, out: str = "code") -> DataFrame:
    """``clean_completion`` as a chain of columns, so that each part is computed once per row."""
    df = df.withColumn("_body", strip(after_first(F.col(output), F.col(prompt))))
    df = df.withColumn("_cut", closing_position(F.col("_body")))
    code = F.when(F.col("_cut").isNull(), F.col("_body")).otherwise(F.substr("_body", F.lit(1), F.col("_cut")))
    return df.withColumn(out, code).drop("_body", "_cut")


def clean_chat_answers(df: DataFrame, output: str, prompt: str, tag: str, out: str = "code") -> DataFrame:
    """Add the function body found in a chat answer: after the response tag, from a fenced block if any.

    A block that names the function is preferred. Null when tag or function name are missing. A chain
    of columns instead of one expression: each part is computed once per row.
    """
    fence = F.lit("```")
    asked = F.element_at(F.split(remove_suffix(rstrip(remove_suffix(rstrip(F.col(prompt)), F.lit(tag))), fence), "```"), -1)
    answer, name, blocks, chosen = (F.col(c) for c in ("_answer", "_name", "_blocks", "_chosen"))
    unfenced = lambda b: remove_suffix(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"\A```", ""), r"\Acpp", ""), r"\Ac\+\+", ""), fence
    )
    named = F.get(F.filter(blocks, lambda b: F.contains(b, name)), F.lit(0))
    opened = F.position(fence, answer)
    from_name = F.substr(chosen, F.position(name, chosen))
    brace = F.position(F.lit("{"), F.col("_from_name"))
    steps = {
        "_answer": strip(after_first(F.col(output), F.lit(tag))),
        "_asked": asked,
        "_name": header_name(F.col("_asked")),
        "_blocks": F.transform(F.regexp_extract_all(answer, F.lit(r"(?s)```\n(.*?)\n```"), 1), unfenced),
        # the first block with the name, else the first block, else what follows an unclosed fence
        "_chosen": F.coalesce(
            named, F.get(blocks, F.lit(0)), F.when(opened > 0, F.substr(answer, opened + 3)), answer
        ),
        "_from_name": from_name,
        # without an opening brace after the name the whole block counts as the body
        "_rest": F.when(brace > 0, F.substr(F.col("_from_name"), brace + 1)).otherwise(chosen),
        "_cut": closing_position(F.col("_rest")),
    }
    for column, value in steps.items():
        df = df.withColumn(column, value)
    body = F.when(F.col("_cut").isNull(), F.col("_rest")).otherwise(F.substr("_rest", F.lit(1), F.col("_cut") - 1))
    code = (
        F.when(answer.isNull() | name.isNull(), F.lit(None).cast("string"))
        .when(F.contains(chosen, name), F.concat(body, F.lit("}")))
        .otherwise(chosen)
    )
    return df.withColumn(out, code).drop(*steps)


def clean_offline(prompt: Column, output: Column) -> Column:
    """Drop a repeated header line; close the body if only the last brace is missing."""
    header = strip(F.element_at(F.split(prompt, "\n"), -1))
    at = F.position(header, output)
    dropped = F.when(
        F.startswith(strip(output), header),
        F.concat(F.substr(output, F.lit(1), at - 1), F.substr(output, at + F.length(header))),
    ).otherwise(output)
    closes = balanced(F.concat(F.lit("{"), dropped, F.lit("}")))
    return F.when(closes, F.concat(dropped, F.lit("}"))).otherwise(dropped)


def strip_fences(output: Column, prompt: Column, mode: str = "chars") -> Column:
    """Remove code fences around an answer and an echoed prompt before it.

    ``chars`` strips any of the characters of the opening fence, ``affix`` the fence as a whole.
    """
    text = strip(output)
    if mode == "chars":
        text = F.rtrim(F.ltrim(F.ltrim(text, F.lit("`cp")), F.lit("`")), F.lit("`"))
    elif mode == "affix":
        fence = F.lit("```")
        text = remove_suffix(remove_prefix(remove_prefix(text, F.lit("```cpp")), fence), fence)
    else:
        raise ValueError(f"unknown mode {mode}")
    return remove_prefix(text, prompt)


def _split_last(s: Column) -> tuple[Column, Column]:
    """(everything up to and including the last newline, last line)."""
    header = F.element_at(F.split(s, "\n"), -1)
    return F.substr(s, F.lit(1), F.length(s) - F.length(header)), header


def suffix_function_name(prompt: Column, suffix: Column) -> Column:
    """Append a suffix to the function's name on the last line; null without a header below other lines."""
    above, header = _split_last(prompt)
    name = F.regexp_extract(header, SUFFIX_HEADER, 1)
    return F.when(
        (F.length(above) > 0) & (name != ""), F.concat(above, F.replace(header, name, F.concat(name, suffix)))
    )


def add_includes(prompt: Column, model: Column) -> Column:
    headers = F.create_map(*[F.lit(v) for pair in INCLUDES.items() for v in pair])
    return F.concat(F.coalesce(F.element_at(headers, model), F.lit("")), prompt)


def insert_keyword(prompt: Column, keyword: str = "NO_INLINE") -> Column:
    """Insert a keyword after the return type on the last line; null if the line has one word."""
    above, header = _split_last(prompt)
    words = F.split(header, " ")
    return F.when(
        F.size(words) > 1, F.concat(above, F.array_join(F.array_insert(words, 2, F.lit(keyword)), " "))
    )


def prefix_lines(s: Column, prefix: str) -> Column:
    """Put ``prefix`` before every line; a trailing line break is dropped."""
    lines = F.split(F.regexp_replace(s, rf"({LINE_BREAK})\z", ""), LINE_BREAK)
    return F.when(s == "", F.lit("")).otherwise(F.concat(F.lit(prefix), F.array_join(lines, "\n" + prefix)))


def fill_slots(template: Column | str, slots: dict[str, Column]) -> Column:
    """Replace ``{slot}`` marks, first slot first."""
    text = F.lit(template) if isinstance(template, str) else template
    for slot, value in slots.items():
        text = F.replace(text, F.lit("{" + slot + "}"), value)
    return text


def format_prompt(prompt: Column, style: str) -> Column:
    """Prompt text in one of the fixed styles; null when a style needs the function name and there is none."""
    template = PROMPT_STYLES[style]
    slots = {}
    if "{function_name}" in template:  # before the prompt goes in, which may hold braces of its own
        slots["function_name"] = header_name(prompt)
    if "{prompt}" in template:
        slots["prompt"] = strip(prompt)
    if "{raw}" in template:
        slots["raw"] = prompt
    return fill_slots(template, slots)


def word_count(s: Column) -> Column:
    """Tokens between runs of white space."""
    trimmed = strip(s)
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"\s+")))
