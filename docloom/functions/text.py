"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CATEGORIES

FENCE = "```"
#: White space by Unicode's White_Space property, of which trim() alone takes only the space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


#: The line of a first fence with its info string, what follows it, and the next line of a fence or the end.
_BLOCK = r"(?mdU)^[^\S\n]*```([^\n]*)(?:\n|\z)(?s:(.*?))(?:^[^\S\n]*```|\z)"


def trim_space(c: Column) -> Column:
    """The text without white space at its ends, in time linear in the text's length."""
    return F.trim(c, F.lit(SPACE))


def strip_all_prefixes(c: Column, prefix: str) -> Column:
    return F.regexp_replace(c, rf"^(?:\Q{prefix}\E)+", "")


def strip_all_suffixes(c: Column, suffix: str) -> Column:
    # from the other end, so that each place is looked at once
    return F.reverse(F.regexp_replace(F.reverse(c), rf"^(?:\Q{suffix[::-1]}\E)+", ""))


def lines(c: Column) -> Column:
    """Lines without their ends; a line end at the very end begins no line."""
    return F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n")


def unfence(c: Column) -> Column:
    """The text without a Markdown fence around it: an answer's JSON."""
    t = trim_space(c)
    return (
        F.when(t.startswith(FENCE + "json"), trim_space(strip_all_suffixes(strip_all_prefixes(t, FENCE + "json"), FENCE)))
        .when(t.startswith(FENCE), trim_space(strip_all_suffixes(strip_all_prefixes(t, FENCE), FENCE)))
        .otherwise(t)
    )


def first_block(c: Column) -> Column:
    """STRUCT<format, body>: the first fenced block of a Markdown text.

    An info string of exactly ``json`` marks JSON, any other YAML.  A block that
    is not closed runs to the end.  No block, or an empty first one, gives null.
    """
    inside = F.replace(F.regexp_extract(c, _BLOCK, 2), F.lit("\r\n"), F.lit("\n"))
    body = F.when((inside == "") | inside.endswith("\n"), inside).otherwise(F.concat(inside, F.lit("\n")))
    info = trim_space(strip_all_prefixes(trim_space(F.regexp_extract(c, _BLOCK, 1)), FENCE))
    block = F.struct(F.when(info == "json", "json").otherwise("yaml").alias("format"), body.alias("body"))
    return F.when(inside != "", block)


def extension(path: Column) -> Column:
    """The extension of a path's last part, or ''; a leading dot begins none."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1)


def with_extension(name: Column, ext: str) -> Column:
    """The file name with its extension replaced, or added where it has none."""
    return F.when(extension(name) == ext, name).otherwise(F.concat(F.regexp_replace(name, r"(?<=[^/])\.[^./]*\z", ""), F.lit("." + ext)))


def topic_file(topic: Column) -> Column:
    """The file name that a topic gives: lower case, spaces as underscores."""
    return F.concat(F.lower(F.replace(topic, F.lit(" "), F.lit("_"))), F.lit(".md"))


def safe_name(name: Column) -> Column:
    """Whether a file name stays inside its folder."""
    return name.isNotNull() & (name != "") & ~name.contains("/") & ~name.contains("\\") & ~name.startswith("..") & (name != ".")


def category(c: Column) -> Column:
    """The category's one spelling, with hyphens; null outside the domain."""
    kebab = F.replace(c, F.lit("_"), F.lit("-"))
    return F.when(kebab.isin(*CATEGORIES), kebab)


def category_directory(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])[category(c)]


def document_path(directory: Column, category_name: Column, file: Column) -> Column:
    return F.concat_ws("/", directory, category_directory(category_name), with_extension(file, "md"))


def estimated_tokens(n_bytes: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(n_bytes / 4)


def utf8_lossy(data: Column | str) -> Column:
    """Bytes as text, each bad sequence replaced."""
    return F.make_valid_utf8((F.col(data) if isinstance(data, str) else data).cast("string"))


def utf8_strict(data: Column) -> Column:
    """Bytes as text, null where they are not valid UTF-8."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
