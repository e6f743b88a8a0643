"""Names, tags and cleaning of text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATION = "站"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_station_name(name: Column) -> Column:
    """Trimmed, without one trailing station sign."""
    return F.regexp_replace(stripped(name), f"{STATION}$", "")


def train_prefix(code: Column) -> Column:
    """The first letter of a train code, P where it has none."""
    return F.when(code.rlike(r"^\p{L}"), F.substring(code, 1, 1)).otherwise("P")


def parse_train_number(line: Column) -> Column:
    """The second of the parts at dots, or the whole line without a dot; null where that is empty."""
    parts = F.split(stripped(line), r"\.")
    return F.nullif(stripped(F.when(F.size(parts) > 1, parts[1]).otherwise(parts[0])), F.lit(""))


def alt_line_name(name: Column) -> Column:
    return F.replace(name, F.lit("线"), F.lit(""))


def route_key(name: Column, ref: Column) -> Column:
    return F.when(F.coalesce(ref, F.lit("")) != "", F.concat(name, F.lit("["), ref, F.lit("]"))).otherwise(name)


def parse_tags(tags: Column) -> Column:
    """'"k"=>"v",...' to a map; the last of equal keys stays, null gives an empty map."""
    pattern = F.lit(r'"([^"]+)"\s*=>\s*"([^"]*)"')
    text = F.coalesce(tags, F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("k"), F.regexp_extract_all(text, pattern, 2).alias("v"))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def is_station_feature(name: Column, tags: Column) -> Column:
    return (tags.contains('"railway"=>"station"') | tags.contains('"railway"=>"halt"')) & (F.coalesce(name, F.lit("")) != "")


def is_route_feature(name: Column, tags: Column) -> Column:
    return tags.contains('"route"=>"railway"') & (F.coalesce(name, F.lit("")) != "")


def is_rail_line(name: Column, kind: Column, wanted: str = "rail") -> Column:
    """Named features of one kind: railway=rail, or fclass=rail, or fclass=railway_station of stations."""
    return F.coalesce(kind == wanted, F.lit(False)) & (F.coalesce(name, F.lit("")) != "")


#: The cleaning rules in order, (what a text must hold for the rule to do anything, pattern, replacement). (?m) with
#: (?d): a line ends at \n alone.
HEADINGS_KEPT = (("##", r"(?mdU)^##\s*(.+)$", "\n=== $1 ===\n"), ("###", r"(?mdU)^###\s*(.+)$", "\n--- $1 ---\n"), ("####", r"(?mdU)^####\s*(.+)$", "\n*** $1 ***\n"))
HEADINGS_DROPPED = (("#", r"(?mdU)^#{1,6}\s*", ""),)
RULES = (
    ("](http", r"\[([^\]]+)\]\(https?://[^\)]+\)", "$1"),
    ("[![", r"\[!\[[^\]]*\]\([^\)]+\)\]\([^\)]+\)", ""),
    ("[![", r"\[!\[[^\]]*\]\([^\)]+\)", ""),
    ("![", r"!\[[^\]]*\]\([^\)]+\)", ""),
    ("]](http", r"\[\[\d+\]\]\(https?://[^\)]+\)", ""),
    ("[[", r"\[\[\d+\]\]", ""),
    ("<", r"<[^>]+>", ""),
    ("\u200b", r"\x{200B}", ""),
    ("\u200c", r"\x{200C}", ""),
    ("\u200d", r"\x{200D}", ""),
    ("\ufeff", r"\x{FEFF}", ""),
    ("  ", r" {2,}", " "),
    ("\t", r"\t", "    "),
    ("\n\n\n", r"\n{3,}", "\n\n"),
    ("](http", r"(?mdU)^-\s*\[\d+\.?\d*\s*[^\]]*\]\(https?://[^\)]+\)\s*$", ""),
    ("]", r"(?mdU)^-\s*\[\d+\.?\d*\s*[^\]]*\]\s*$", ""),
)
SYMBOLS_ONLY, URL_ONLY = r"(?U)^[\s\-|*=#]*\z", r"(?U)^\s*https?://\S+\s*\z"


def clean_text(text: Column, keep_structure: bool = True) -> Column:
    """Markdown, links, citations, tags and white space cleaned rule by rule; blank, symbol-only and
    URL-only lines go. Null stays null. A rule runs where a text holds what the rule asks for."""

    def rule(needed: str, pattern: str, to: str):
        return lambda x: F.when(x.contains(needed), F.regexp_replace(x, pattern, to)).otherwise(x)

    out = F.array(text)
    for needed, pattern, to in (HEADINGS_KEPT if keep_structure else HEADINGS_DROPPED) + RULES:
        out = F.transform(out, rule(needed, pattern, to))
    kept = F.filter(F.split(F.element_at(out, 1), "\n"), lambda x: ~(x.rlike(SYMBOLS_ONLY) | (x.contains("://") & x.rlike(URL_ONLY))))
    return stripped(F.array_join(kept, "\n"))
