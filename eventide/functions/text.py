"""Text expressions: names, category values, tokens, redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(x: Column) -> Column:
    """Trimmed, lower case, runs of anything but letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def norm_value(x: Column) -> Column:
    """Lower case, runs of blanks and underscores as one underscore, none at the ends."""
    return F.regexp_replace(category_key(x), "^_+|_+$", "")


def category_key(x: Column) -> Column:
    """Like ``norm_value`` but keeps underscores at the ends."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[\s_]+", "_")


def trim_lower(x: Column) -> Column:
    return F.lower(F.trim(x))


def mapped(x: Column, rules: Sequence[tuple[Column | None, Mapping[str | None, str]]]) -> Column:
    """Conditional value mapping: the first rule whose condition holds (None: always) and whose map has the value wins; else the raw value.

    The key None maps nulls.
    """
    out = None
    for condition, values in rules:
        for raw, to in values.items():
            here = x.isNull() if raw is None else x == F.lit(raw)
            here = here if condition is None else condition & here
            out = F.when(here, F.lit(to)) if out is None else out.when(here, F.lit(to))
    return x if out is None else out.otherwise(x)


def flag(x: Column) -> Column:
    """'1' or '0' for the spellings of a boolean or 0/1 flag, else null."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin("1", "1.0", "true", "t", "yes", "y"), "1").when(t.isin("0", "0.0", "false", "f", "no", "n"), "0")


def categorical_token(concept: Column, value: Column) -> Column:
    """``concept=value``; a bare integer becomes ``cat_<n>``; blanks give null."""
    v = norm_value(value)
    named = F.when(v.rlike(r"^[+-]?[0-9]+$"), F.concat(F.lit("cat_"), v)).otherwise(v)
    return F.when(v != "", F.concat(concept, F.lit("="), named))


def bin_token(concept: Column, index: Column) -> Column:
    """``concept#bin``; null without a bin."""
    return F.concat(concept, F.lit("#"), index.cast("string"))


def split_token(token: Column) -> Column:
    """Struct (kind, concept, detail) of a token: 'bin', 'category' or 'bare'."""
    kind = F.when(token.contains("#"), "bin").when(token.contains("="), "category").otherwise("bare")
    mark = F.when(token.contains("#"), F.instr(token, "#")).when(token.contains("="), F.instr(token, "="))
    return F.struct(
        kind.alias("kind"),
        F.coalesce(F.substring(token, F.lit(1), mark - 1), token).alias("concept"),
        F.substring(token, mark + 1, F.length(token)).alias("detail"),
    )


def split_measure(name: Column, units: Sequence[str]) -> Column:
    """Struct (what, unit) of a name that ends in a unit part such as ``drug_mcg_kg_min``; unit null without one."""
    tail = "|".join(sorted(units, key=len, reverse=True))
    pattern = rf"^(.+)_({tail})$"
    has = name.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("what"), F.when(has, F.regexp_extract(name, pattern, 2)).alias("unit"))


def redact(x: Column) -> Column:
    """Hides values of identifier keys, paths, long digit runs and quoted strings in log text."""
    keys = "patient_id|hospitalization_id|hosp_id|encounter_id|subject_id|stay_id|mrn"
    out = F.regexp_replace(x, rf"(?i)(^|[^a-z0-9_])({keys})[\t ]*[=:][\t ]*[^\t\n\r\f ]+", "$1$2=<redacted>")
    out = F.regexp_replace(out, r"(?:/[A-Za-z0-9._-]+){2,}", "<path>")
    out = F.regexp_replace(out, r'"[^"]*"', '"<text>"')
    return F.regexp_replace(out, r"[0-9]{5,}", "<number>")


def label(x: Column, mapping: Mapping[str, str], unknown: str = "unknown") -> Column:
    """Mapped label of a trimmed, lower-case value, else ``unknown``."""
    keys = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.coalesce(F.try_element_at(keys, trim_lower(x)), F.lit(unknown))


def matches_any_prefix(code: Column, prefixes: Sequence[str]) -> Column:
    """Whether a code, without dots and blanks and in upper case, starts with one of ``prefixes``."""
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]", "").rlike("^(?:" + "|".join(prefixes) + ")")


def split_sequence(x: Column, spaced: Sequence[str]) -> Column:
    """Tokens of a space-joined sequence, where the tokens in ``spaced`` hold spaces themselves; the longest one wins at every place."""
    if not spaced:
        return F.split(F.trim(x), r"\s+")
    escape = lambda t: "".join(c if c.isalnum() or c == "_" else "\\" + c for c in t)
    names = "|".join(escape(t) for t in sorted(spaced, key=len, reverse=True))
    return F.regexp_extract_all(x, F.lit(rf"((?<!\S)(?:{names})(?!\S)|\S+)"), 1)


def describe_token(token: Column, unit: Column, lo: Column, hi: Column) -> Column:
    """Readable text of a binned or categorical token."""
    s = split_token(token)
    span = F.when(lo.isNull(), F.format_string("< %s", hi.cast("string"))).when(hi.isNull(), F.format_string(">= %s", lo.cast("string"))).otherwise(F.format_string("%s to %s", lo.cast("string"), hi.cast("string")))
    what = F.regexp_replace(s["concept"], "_", " ")
    return F.when(s["kind"] == "bin", F.concat_ws(" ", what, span, unit)).when(s["kind"] == "category", F.concat_ws(" ", what, F.lit("is"), s["detail"])).otherwise(what)
