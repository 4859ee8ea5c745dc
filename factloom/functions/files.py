"""What a file is and why one is skipped, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories and extensions that are never read.  Working folders of particular tools are passed beside them.
IGNORED_DIRS = (
    ".git node_modules dist build out .next coverage parse_cache learn_site context-pack packs "
    "outputs reports assets public static vendor .venv __pycache__"
).split()
IGNORED_EXTENSIONS = ".csv .tsv .jsonl .ndjson .sqlite .db .pdf .png .jpg .jpeg .webp .gif .zip .7z .tar .gz .mp3 .mp4 .wav .woff .woff2 .ttf".split()
IGNORED_NAME_PART = "cedict"
LANGUAGE_OF = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".go": "go", ".java": "java",
    ".c": "cxx", ".h": "cxx", ".cpp": "cxx", ".cc": "cxx", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
}
PRINTABLE_SHARE = 0.7
SAMPLE_BYTES = 8192


def extension(path: Column) -> Column:
    """Last suffix of the base name with its dot, lower case; '' where there is none or it leads the name."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def language(path: Column) -> Column:
    e = extension(path)
    out = F.lit("text")
    for name in sorted(set(LANGUAGE_OF.values())):
        out = F.when(e.isin([k for k, v in LANGUAGE_OF.items() if v == name]), name).otherwise(out)
    return out


def lines(text: Column) -> Column:
    """Lines without their ends; a newline at the end begins no line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n"))


def snippet(all_lines: Column, start: Column, end: Column, context: int) -> Column:
    """The lines from start to end with context on both sides, clamped to the file."""
    a, b = F.greatest(F.lit(1), start - context), F.least(F.size(all_lines), end + context)
    return F.array_join(F.slice(all_lines, a, F.greatest(F.lit(0), b - a + 1)), "\n")


def clamp_lines(text: Column, most: int) -> Column:
    return F.when(F.size(lines(text)) > most, F.array_join(F.slice(lines(text), 1, most), "\n")).otherwise(text)


def clamp_bytes(text: Column, most: int) -> Column:
    """At most so many UTF-8 bytes, cut before a character that would be torn."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(raw) <= most, text).otherwise(F.regexp_replace(F.decode(F.substring(raw, 1, most), "UTF-8"), "�+$", ""))
