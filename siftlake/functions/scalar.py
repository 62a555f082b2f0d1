"""Column functions for keys, paths, severities, numbers and formats.

All take and return columns and stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def blank_to_null(x: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(x, F.lit(""))


def or_default(x: Column, default: str | int) -> Column:
    """``default`` for null, and for empty strings or zeros, which count as missing."""
    return F.coalesce(F.nullif(x, F.lit("" if isinstance(default, str) else 0)), F.lit(default))


# ---------------------------------------------------------------- keys and URLs


def _no_slash(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def _segment(url: Column, n: int) -> Column:
    return F.try_element_at(F.split(_no_slash(url), "/"), F.lit(n))


def repo_key(url: Column, short: str = "join") -> Column:
    """``owner__name`` from a URL's last two segments.

    ``short`` tells what becomes of a text without a slash: ``join`` replaces
    slashes by two underscores, ``keep`` leaves it, ``file`` also replaces colons.
    """
    rest = {"join": F.replace(url, F.lit("/"), F.lit("__")), "keep": url, "file": F.replace(F.replace(url, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))}[short]
    return F.when(_segment(url, -2).isNotNull(), F.concat_ws("__", _segment(url, -2), _segment(url, -1))).otherwise(rest)


def file_name(url: Column) -> Column:
    return F.concat(repo_key(url, "file"), F.lit(".json"))


def key_to_url(key: Column) -> Column:
    """Repository URL from ``owner__name``, split at the first pair of underscores."""
    at = F.instr(key, "__")
    return F.when(at > 0, F.concat(F.lit("https://github.com/"), F.substring(key, F.lit(1), at - 1), F.lit("/"), F.substring(key, at + 2, F.length(key)))).otherwise(key)


def normalize_url(url: Column) -> Column:
    return _no_slash(F.trim(F.coalesce(url, F.lit(""))))


def url_key(url: Column) -> Column:
    return F.lower(normalize_url(url))


def expand_repo(value: Column) -> Column:
    """A full URL from ``owner/name``; URLs stay."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when((v == "") | F.startswith(v, F.lit("http")), v).otherwise(F.concat(F.lit("https://github.com/"), v))


def owner_and_name(url: Column) -> Column:
    """Struct of owner and name; null with fewer than two segments."""
    return F.when(_segment(url, -2).isNotNull(), F.struct(_segment(url, -2).alias("owner"), _segment(url, -1).alias("name")))


def parse_repo_url(url: Column) -> Column:
    """Struct of owner and name of a hosted repository, without ``.git``; null for other texts."""
    m = lambda i: blank_to_null(F.regexp_extract(F.trim(url), r"github\.com[/:]([^/]+)/([^/]+?)(?:\.git)?/?$", i))
    return F.when(m(1).isNotNull() & m(2).isNotNull(), F.struct(m(1).alias("owner"), m(2).alias("name")))


def prefix_key(url: Column) -> Column:
    """Key by dropping the host and replacing every slash, which keeps further segments."""
    return F.replace(F.replace(normalize_url(url), F.lit("https://github.com/"), F.lit("")), F.lit("/"), F.lit("__"))


def finding_key(url: Column, stage: Column, rule_id: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (url, stage, rule_id)))


# ---------------------------------------------------------------- paths


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.try_element_at(F.split(posix(path), "/"), F.lit(-1))


def strip_dots(path: Column) -> Column:
    """Without any leading dots and slashes: a set of characters, so ``.github/x`` loses its dot too."""
    return F.ltrim(path, F.lit("./"))


def to_relative(root: Column, path: Column) -> Column:
    """Path below ``root`` with forward slashes; paths elsewhere stay; empty for null."""
    p, r = posix(F.coalesce(path, F.lit(""))), F.concat(_no_slash(posix(root)), F.lit("/"))
    return F.when(F.startswith(p, r), F.substring(p, F.length(r) + 1, F.length(p))).otherwise(p)


def is_dependency_file(path: Column) -> Column:
    base, parts = F.lower(base_name(path)), F.split(posix(path), "/")
    listed = base.isin(*dims.DEPENDENCY_FILES) | (F.array_contains(parts, "requirements") & F.endswith(base, F.lit(".txt")))
    return F.coalesce(listed | F.endswith(base, F.lit("-requirements.txt")) | F.startswith(base, F.lit("requirements-")), F.lit(False))


def is_dockerfile(path: Column) -> Column:
    low = F.lower(base_name(path))
    documents = low.rlike(r"\.(md|txt|rst)$")
    return (low == "dockerfile") | (F.startswith(low, F.lit("dockerfile.")) & ~documents) | F.endswith(low, F.lit(".dockerfile"))


def is_model_file(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(e.replace(".", "[.]") for e in dims.MODEL_EXTENSIONS) + ")$")


def is_requirements_file(path: Column) -> Column:
    return path.isin(*dims.REQUIREMENT_FILES) | path.rlike(r"^requirements/[^/]+[.]txt$")


def in_directory(path: Column, names: Iterable[str]) -> Column:
    """True if one of the directories on the path has one of the names."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, names)))


# ---------------------------------------------------------------- severities and categories


def normalize_severity(value: Column) -> Column:
    s = F.lower(F.trim(value.cast("string")))
    out = F.when(s.isNull() | (s == ""), "unknown")
    for name, words in dims.SEVERITY_WORDS.items():
        out = out.when(s.isin(*words), name)
    return out.otherwise(s)


def control_category(rule_id: Column) -> Column:
    """Category of an absent-control rule; null if it isn't one of the known."""
    rest = F.regexp_extract(rule_id, r"^absent_control[.](.*)$", 1)
    return F.when(rest.isin(*dims.CONTROL_CATEGORIES), rest)


def strip_control_prefix(rule_id: Column) -> Column:
    return F.regexp_replace(rule_id, r"^absent_control[.]", "")


def severity_source(tool: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in dims.SEVERITY_SOURCE.items() for x in pair)), F.lower(tool))


# ---------------------------------------------------------------- numbers and times


def digits(value: Column) -> Column:
    """Long from a text of digits only; anything else, signs included, is null."""
    v = F.trim(value)
    return F.when(v.rlike("^[0-9]+$"), v.try_cast("long"))


def parse_time(value: Column) -> Column:
    return F.try_to_timestamp(value)


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole 24-hour days from one timestamp to another, rounded down."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000.0)).cast("long")


def valid_predictor(value: Column, name: str) -> Column:
    """The value as a double if it may take part in a correlation: positive, and not below the floor for commit counts."""
    floor = dims.MIN_COMMIT_COUNT if name == "commit_count" else 0
    return F.when((value > 0) & (value >= floor), value.cast("double"))


def density(count: Column, loc: Column) -> Column:
    """Per thousand lines; null where lines are null or zero."""
    return F.try_divide(F.lit(1000.0) * count, loc.cast("double"))


def format_weight(x: Column) -> Column:
    """Whole weights without decimals, others with two."""
    return F.when(F.abs(x - F.round(x)) < 1e-9, F.round(x).cast("long").cast("string")).otherwise(F.format_string("%.2f", x))


def rounded(x: Column, places: int = 3) -> Column:
    return F.round(x, places)


# ---------------------------------------------------------------- evidence texts


def evidence_text(path: Column, line: Column, call: Column, pattern: Column) -> Column:
    return F.format_string("%s:%s %s [matched %s]", path, line.cast("string"), call, pattern)


def missing_stages_text(present: Column) -> Column:
    """``missing: a, b`` in pipeline order; empty if all stages are there."""
    missing = F.array_except(F.array(*map(F.lit, dims.PIPELINE_STAGES)), F.coalesce(present, F.array().cast("array<string>")))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).otherwise(F.lit(""))


def split_call(entry: Column) -> Column:
    """Struct of name and line from ``name@line``, split from the right; line 0 without one."""
    m = lambda i: F.regexp_extract(entry, r"^(.*)@([0-9]+)$", i)
    named = entry.rlike(r"@[0-9]+$")
    return F.struct(F.when(named, m(1)).otherwise(entry).alias("name"), F.when(named, m(2).try_cast("int")).otherwise(F.lit(0)).alias("line"))


def short_aliases(dotted: Column) -> Column:
    """A dotted name whose module prefix is replaced by its usual short name; the first listed module that fits wins."""
    out = None
    for module, short in dims.MODULE_ALIASES.items():
        fits = (dotted == module) | F.startswith(dotted, F.lit(module + "."))
        new = F.concat(F.lit(short), F.substring(dotted, F.lit(len(module) + 1), F.length(dotted)))
        out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(dotted)


def line_count(content: Column) -> Column:
    """Lines of a file; a last line without a newline counts."""
    n = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(content.isNull(), None).otherwise(n + F.when((content != "") & ~F.endswith(content, F.lit("\n")), 1).otherwise(0)).cast("long")


def failure_reason(stderr: Column, markers: Iterable[str] = ("fatal", "error", "remote"), most: int = 300) -> Column:
    """First line of an error output that has a marker, else its last line, cut to ``most`` characters."""
    lines = F.filter(F.split(F.coalesce(stderr, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    low = F.array(*map(F.lit, markers))
    marked = F.filter(lines, lambda x: F.exists(low, lambda m: F.contains(F.lower(x), m)))
    return F.substring(F.trim(F.coalesce(F.get(marked, F.lit(0)), F.try_element_at(lines, F.lit(-1)), F.lit(""))), 1, most)


def last_page(link_header: Column) -> Column:
    """Page number of the ``rel="last"`` entry of a Link header; null without one."""
    return blank_to_null(F.regexp_extract(link_header, r'[?&]page=([0-9]+)[^>]*>;\s*rel="last"', 1)).cast("long")

