"""Text functions: keyword triage, excerpts, code fences, notebooks, budgets."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims, schemas


def keyword_pattern(words: Iterable[str] = dims.ISSUE_KEYWORDS) -> str:
    """Alternation in list order, so that earlier words win at a place.

    Words are grouped by their first characters, and a place that has none of these is passed over: words of different groups
    can't match at one place, so the order inside groups is enough.
    """
    words = tuple(words)
    if not words or not all(words):
        return "(?i)" + "|".join(map(re.escape, words))
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0].lower() if w[0].isascii() else w[0], []).append(w[1:])
    heads = {re.escape(h): "|".join(map(re.escape, rests)) for h, rests in groups.items()}
    return f"(?i)(?=[{''.join(heads)}])(?:{'|'.join(f'{h}(?:{rests})' for h, rests in heads.items())})"


def keywords(text: Column, words: Iterable[str] = dims.ISSUE_KEYWORDS) -> Column:
    """Sorted distinct keywords of a text in lower case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(keyword_pattern(words)), 0)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def excerpt(body: Column, most: int = 400) -> Column:
    """One line of at most ``most`` characters."""
    return F.substring(F.translate(F.coalesce(body, F.lit("")), "\r\n", "  "), 1, most)


def join_labels(labels: Column) -> Column:
    return F.array_join(labels, ";")


def strip_code_fence(text: Column) -> Column:
    """Without a surrounding Markdown fence, with or without a language name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""), F.lit(" \n\r\t"))


def parse_checks(text: Column) -> Column:
    """Array of checks from a model's JSON answer; null if it isn't one."""
    return F.from_json(strip_code_fence(text), schemas.CHECKS, {"mode": "PERMISSIVE"})["checks"]


def notebook_source(content: Column) -> Column:
    """Code cells of a notebook as one module, with magics commented out; null if it isn't JSON."""
    marked = lambda line: F.when(F.ltrim(line, F.lit(" \t")).rlike("^[%!]"), F.concat(F.lit("# [magic] "), line)).otherwise(line)
    one = F.from_json(content, "cells array<struct<cell_type: string, source: array<string>>>")
    flat = F.from_json(content, "cells array<struct<cell_type: string, source: string>>")
    # sources are lists of lines or one text; a list is read as JSON text by the second schema
    cells = F.arrays_zip(one["cells"].alias("a"), flat["cells"].alias("b"))
    source = lambda c: F.coalesce(F.array_join(c["a"]["source"], ""), c["b"]["source"])
    code = F.transform(F.filter(cells, lambda c: F.coalesce(c["a"]["cell_type"], c["b"]["cell_type"]) == "code"), source)
    lines = lambda s: F.split(F.regexp_replace(s, r"\r?\n$", ""), r"\r?\n")
    return F.array_join(F.transform(code, lambda s: F.array_join(F.transform(lines(s), marked), "\n")), "\n\n# --- cell boundary ---\n\n")


def console_scripts(file: Column, content: Column) -> Column:
    """Dotted modules that a packaging file declares as scripts, in order.

    Only 4000 characters from the first script section on are read; without
    one, ``setup.cfg`` is read whole and other files declare nothing.
    """
    marker = r"console_scripts|\[project\.scripts\]|\[tool\.poetry\.scripts\]"
    at = F.length(F.regexp_extract(content, rf"(?s)^(.*?)(?:{marker})", 1))
    region = F.when(content.rlike(marker), F.substring(content, at + 1, F.lit(4000))).when(base_is_cfg(file), content)
    return F.regexp_extract_all(region, F.lit(r"""["']?\s*[A-Za-z_][\w\-]*\s*=\s*["']?\s*([A-Za-z_][\w.]*)\s*:\s*[A-Za-z_]\w*\s*["']?"""), 1)


def base_is_cfg(file: Column) -> Column:
    return F.endswith(file, F.lit("setup.cfg"))


def shell_python(text: Column) -> Column:
    """Struct of module or script that a shell script's first Python command runs; both null without one."""
    pattern = r"\bpython[0-9.]*\s+(?:-[A-Za-z]+\s+)*?(?:-m\s+([\w.]+)|([^\s;&|]+\.py))"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(part(1).alias("module"), F.ltrim(part(2), F.lit("./")).alias("script"))


def prompt(stage: Column, questions: Column, code: Column) -> Column:
    """A stage's audit prompt from its list of questions and the code slice."""
    numbered = F.transform(questions, lambda q, i: F.concat((i + 1).cast("string"), F.lit(". "), q))
    return F.concat_ws("\n\n", F.concat(F.lit("Stage: "), stage), F.array_join(numbered, "\n"), F.concat(F.lit("Code:\n"), code))
