"""Documents of the four categories as Column expressions.

Values are escaped for HTML (& < > " ' ` =); a missing field renders empty.
A tutorial's step has its number and title on one heading line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the escaped characters, & first
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("`", "&#x60;"), ("=", "&#x3D;"))
#: (heading, field) of each category's sections; a field ``steps`` is a list.
SECTIONS: dict[str, Sequence[tuple[str, str]]] = {
    "tutorial": (("Introduction", "introduction"), ("Prerequisites", "prerequisites"), ("Step-by-Step Guide", "steps"), ("Conclusion", "conclusion")),
    "how-to": (("Problem", "problem"), ("Solution", "solution"), ("Steps", "steps"), ("Discussion", "discussion")),
    "explanation": (("Overview", "overview"), ("Concepts", "concepts"), ("Architecture", "architecture"), ("Design Decisions", "design_decisions")),
    "reference": (("Description", "description"), ("Usage", "usage"), ("API", "api"), ("Examples", "examples")),
}
TUTORIAL_STEPS = "array<struct<number:bigint,title:string,content:string>>"
HOW_TO_STEPS = "array<string>"


def escape(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for plain, escaped in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def _title(name: str, title: Column) -> Column:
    return F.concat(F.lit("# How to " if name == "how-to" else "# "), escape(title), F.lit("\n"))


def _steps(name: str, steps: Column) -> Column:
    def one(s: Column) -> Column:
        if name == "tutorial":
            return F.concat(F.lit("\n### Step "), escape(s["number"]), F.lit(": "), escape(s["title"]), F.lit("\n"), escape(s["content"]), F.lit("\n"))
        return F.concat(F.lit("1. "), escape(s), F.lit("\n"))

    return F.coalesce(F.array_join(F.transform(steps, one), ""), F.lit(""))


def render(name: str, fields: dict[str, Column]) -> Column:
    """One category's document from its fields; ``steps`` as TUTORIAL_STEPS or HOW_TO_STEPS."""
    parts = [_title(name, fields.get("title", F.lit(None)))]
    for heading, field in SECTIONS[name]:
        parts.append(F.lit(f"\n## {heading}\n"))
        value = fields.get(field)
        if field == "steps":
            parts.append(_steps(name, value) if value is not None else F.lit(""))
        else:
            parts += [escape(value if value is not None else F.lit(None)), F.lit("\n")]
    return F.concat(*parts)


def render_variant(category: Column, data: Column) -> Column:
    """A document of the row's category from a VARIANT; null for an unknown category."""
    out = None
    for name, sections in SECTIONS.items():
        fields = {f: F.try_variant_get(data, f"$.{f}", "string") for f in ["title", *(f for _, f in sections if f != "steps")]}
        if any(f == "steps" for _, f in sections):
            fields["steps"] = F.try_variant_get(data, "$.steps", TUTORIAL_STEPS if name == "tutorial" else HOW_TO_STEPS)
        expr = render(name, fields)
        out = F.when(category == name, expr) if out is None else out.when(category == name, expr)
    return out
