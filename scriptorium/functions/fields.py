"""Nested fields, envelopes and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _col, extract_all, strip


def from_json_or_empty(c: Column | str, schema: str) -> Column:
    """JSON text to an array; unreadable text gives an empty array."""
    return F.coalesce(F.from_json(_col(c), schema), F.from_json(F.lit("[]"), schema))


def decode_nested(rows: DataFrame, lists: dict[str, str] = {}, objects: dict[str, str] = {}, flags: tuple[str, ...] = ()) -> DataFrame:
    """Stored JSON columns as values: ``lists`` and ``objects`` map a column to its schema.

    An unreadable or missing list is empty, an unreadable or missing object has null fields,
    an element that does not fit its schema is null; a flag is true for any number but 0 and
    false for null. Columns that the table lacks are passed over.
    """
    out = {c: from_json_or_empty(c, schema) for c, schema in lists.items() if c in rows.columns}
    out |= {c: F.coalesce(F.from_json(F.col(c), schema), F.from_json(F.lit("{}"), schema)) for c, schema in objects.items() if c in rows.columns}
    out |= {c: F.coalesce(F.col(c).cast("double") != 0, F.lit(False)) for c in flags if c in rows.columns}
    return rows.withColumns(out)


def summary_list(c: Column | str) -> Column:
    return F.filter(from_json_or_empty(c, "array<string>"), lambda x: x.isNotNull())


def _fenced(c: Column) -> Column:
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"
    return F.when(c.rlike(fence), strip(F.regexp_extract(c, fence, 1))).otherwise(strip(c))


def tolerant_json(c: Column | str, schema: str) -> Column:
    """A JSON object or array inside a fence or inside other words."""
    text = _fenced(_col(c))
    first, last = ("[", "]") if schema.startswith("array") else ("{", "}")
    start = F.instr(text, first)
    end = F.length(text) - F.instr(F.reverse(text), last) + 1
    whole = text.startswith(first) & text.endswith(last)
    inner = F.substring(text, start, end - start + 1)
    opts = {"mode": "PERMISSIVE"}
    return F.when(whole, F.from_json(text, schema, opts)).when(
        (start > 0) & F.contains(text, F.lit(last)) & (end > start), F.from_json(inner, schema, opts)
    )


def delimited_candidate(c: Column | str, tag: str = "revised") -> Column:
    """The last envelope in ``tag``; none means no candidate."""
    found = F.regexp_extract_all(_col(c), F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    text = strip(F.try_element_at(found, F.lit(-1)))
    return F.when(text != "", text)


def candidate(c: Column | str, structured: bool = False, tag: str = "revised") -> Column:
    """The revised text of a response, never the whole response."""
    plain = delimited_candidate(c, tag)
    if not structured:
        return plain
    text = strip(tolerant_json(c, "struct<text:string>")["text"])
    return F.coalesce(F.when(text != "", text), plain)


def yaml_str(c: Column | str) -> Column:
    text = _col(c)
    quoted = F.concat(
        F.lit('"'),
        F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
        F.lit('"'),
    )
    special = text.rlike(r"[:#{}\[\]&*!|>'\"%@`,]") | (text != strip(text))
    return F.when(text == "", F.lit('""')).when(special, quoted).otherwise(text)


def yaml_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, yaml_str), ", "), F.lit("]"))


def safe_filename(name: Column | str, extension: str, default: str = "document") -> Column:
    path = F.regexp_replace(F.coalesce(_col(name), F.lit("")), r"\\", "/")
    path = F.when(path == "", F.lit(default)).otherwise(F.regexp_replace(path, r"/+$", ""))
    base = F.substring_index(path, "/", -1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)
    text = strip(F.regexp_replace(stem, r"[^\p{L}\p{N}_\- ]+", ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", "-"), r"^-+|-+$", "")
    text = F.when(text == "", F.lit(default)).otherwise(text)
    return F.concat(F.left(text, F.lit(80)), F.lit("." + extension))


def filename_for(name: Column, default: str = "Document") -> Column:
    """A note name without characters that file systems refuse."""
    text = F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', ""))
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[ .]+|[ .]+$", "")
    text = F.left(text, F.lit(150))
    return F.when(text == "", F.lit(default)).otherwise(text)


def safe_name(name: Column) -> Column:
    text = F.trim(F.regexp_replace(name, r'[\\/:*?"<>|\x00-\x1f]', ""))
    return F.when(text == "", F.lit("Sans titre")).otherwise(text)


def note_name(path: Column) -> Column:
    name = F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1)
    return F.regexp_replace(name, r"(?i)\.md$", "")


def dotted(name: Column) -> Column:
    """A short capital name, which may be written with dots and blanks between its letters."""
    compact = F.replace(name, F.lit("."), F.lit(""))
    return (F.upper(compact) == compact) & (F.length(compact) <= 8) & compact.rlike(r"^\p{L}+$") & ~F.contains(name, F.lit(" "))


def alias_pattern(name: Column) -> Column:
    """A regular expression that finds a name whatever its accents or dots.

    Short capital names match with dots and blanks between letters.
    """
    compact = F.replace(name, F.lit("."), F.lit(""))
    caps = F.array_join(F.split(compact, ""), r"\.?\s*")
    caps = F.concat(caps, F.lit(r"\.?"))
    loose = F.regexp_replace(name, r"[\\^$.|?*+()\[\]{}]", r"\\$0")
    # fixed values: accent variants of each base letter
    for base, variants in (
        ("a", "aàâä"), ("c", "cç"), ("e", "eéèêë"), ("i", "iîï"), ("o", "oôö"), ("u", "uùûü"), ("y", "yÿ"),
    ):
        loose = F.regexp_replace(loose, rf"(?iu)[{variants}]", f"\u0001{base}\u0002")
    loose = F.regexp_replace(loose, r"\s+", r"\\s+")
    loose = F.regexp_replace(loose, "['’]", "['’]")
    for base, variants in (
        ("a", "aàâä"), ("c", "cç"), ("e", "eéèêë"), ("i", "iîï"), ("o", "oôö"), ("u", "uùûü"), ("y", "yÿ"),
    ):
        loose = F.replace(loose, F.lit(f"\u0001{base}\u0002"), F.lit(f"[{variants}]"))
    body = F.when(dotted(name), caps).otherwise(loose)
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), body, F.lit(r"(?![\p{L}\p{N}_])"))
