"""Step plans from YAML, JSON or Markdown texts to tables.

A plan file is one row; its format is its extension (exactly in lower case, YAML
without one).  YAML becomes JSON in a pandas UDF, since Spark has no YAML reader;
everything after that is VARIANT expressions.  A wrong plan is a row with an
error, never a failed job; ``strict`` raises instead.
"""

from __future__ import annotations

import functools
import json
from typing import Any

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..functions import jsons
from ..functions.text import category, extension, first_block
from ..model import ACTIONS, PLAN, PLAN_FORMATS
from ..sources.documents import file_system
from ..sources.files import TreeSource


#: What a URI quotes of a path, in Spark's own spelling.
_QUOTED = "% \"#<>?[\\]^`{|}"


def _uri(root: str, path: Column) -> Column:
    """The URI of a path below a folder, quoted as Spark quotes those of files."""
    quoted = path
    for c in _QUOTED:
        quoted = F.replace(quoted, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit(root), F.when(path.rlike(r"[^A-Za-z0-9_.\-]"), quoted).otherwise(path))


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, content) of whole plan files: those in a folder, or what else Spark's text source takes.

    A folder is read as a tree, whose files the driver does not list one by one.
    """
    try:
        store, root = file_system(path)
        folder = store.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowInvalid, OSError):
        folder = False
    if folder:
        spark.dataSource.register(TreeSource)
        tree = spark.read.format("tree").option("gitignore", "false").option("ignore", "_*\n!_*=*\n.*\n*._COPYING_\n*/").load(path)
        below = "file:" + "".join(f"%{ord(c):02X}" if c in _QUOTED else c for c in root) if isinstance(store, fs.LocalFileSystem) else path.rstrip("/")
        files = tree.select(_uri(f"{below}/", F.col("path")).alias("path"), F.col("content").cast("string").alias("content"))
    else:
        files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    ext = extension(F.col("path"))
    return files.select("path", F.when(ext == "", "yaml").otherwise(ext).alias("format"), "content")


@functools.cache
def _yaml_loader() -> Any:
    """YAML's core schema: null, true/false, numbers; yes/no/on stay strings.  Built once a worker, on the C parser where there is one."""
    import re

    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

    for tag, pattern, first in (
        ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
        ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
        ("int", r"[-+]?[0-9]+", list("-+0123456789")),
        ("float", r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?", list("-+.0123456789")),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(rf"^(?:{pattern})$"), first)
    return Loader


def _plain(node: Any) -> Any:
    """The value of a node of texts, lists and maps with texts as keys; ValueError where there is another."""
    if node.tag == "tag:yaml.org,2002:str" and node.id == "scalar":
        return node.value
    if node.tag == "tag:yaml.org,2002:seq" and node.id == "sequence":
        return [_plain(v) for v in node.value]
    if node.tag != "tag:yaml.org,2002:map" or node.id != "mapping" or any(k.tag != "tag:yaml.org,2002:str" or k.id != "scalar" for k, _ in node.value):
        raise ValueError(node.tag)
    return {k.value: _plain(v) for k, v in node.value}


def _loaded(text: str, loader: Any) -> Any:
    """The value of a YAML text; what is not plain, may refer to itself or is deep goes through all of the loader."""
    one = loader(text)
    try:
        node = one.get_single_node()
        if node is None:
            return None
        try:
            if "&" not in text:
                return _plain(node)
        except (ValueError, RecursionError):
            pass
        return one.construct_document(node)
    finally:
        one.dispose()


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("problem", T.StringType())]))
def _yaml_to_json(content: pd.Series) -> pd.DataFrame:
    import yaml

    loader = _yaml_loader()

    def one(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return json.dumps(_loaded(text, loader), allow_nan=False), None
        except (yaml.YAMLError, ValueError, TypeError) as e:
            return None, str(e).split("\n")[0]

    return pd.DataFrame([one(t) for t in content], columns=["json", "problem"])


def _texts_in(v: Column, path: str, of: str = "$") -> Column:
    """Whether the array at a path holds only strings (at ``of`` in each element)."""
    each = F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(F.forall(each, lambda x: F.coalesce(jsons.kind(x, of) == "STRING", F.lit(False))), F.lit(False))


def _plan_problem(v: Column) -> Column:
    """What is wrong with a parsed plan, or null."""
    steps = F.try_variant_get(v, "$.steps", "array<variant>")

    def step_problem(s: Column) -> Column:
        # bound: the type would else be looked up again for each action that it is compared with
        return F.transform(F.array(jsons.text_at(s, "$.action.type")), lambda kind: problem_of(s, kind))[0]

    def problem_of(s: Column, kind: Column) -> Column:
        unknown = F.when(kind.isNull() | ~kind.isin(*ACTIONS), "unknown action")
        bad = F.coalesce(F.when(~jsons.is_object(s), "a step is not an object"), *[F.when(jsons.text_at(s, f"$.{f}").isNull(), f"a step needs the text {f}") for f in ("id", "description")], unknown)
        for action, parameter in ACTIONS.items():
            if parameter is None:
                wrong = ~jsons.is_null(s, "$.action.params")
            elif parameter == "category":
                value = jsons.text_at(s, "$.action.params.category")
                wrong = category(value).isNull() | value.contains("-")
            else:
                wrong = jsons.text_at(s, f"$.action.params.{parameter}").isNull()
            bad = F.coalesce(bad, F.when((kind == action) & F.coalesce(wrong, F.lit(True)), f"wrong params of {action}"))
        listed = jsons.kind(s, "$.dependencies").isNull() | _texts_in(s, "$.dependencies")
        return F.coalesce(bad, F.when(~listed, "dependencies must be a list of texts"))

    deliverables = F.try_variant_get(v, "$.deliverables", "array<variant>")
    whole = F.coalesce(F.forall(deliverables, lambda d: jsons.text_at(d, "$.name").isNotNull() & jsons.text_at(d, "$.description").isNotNull() & jsons.text_at(d, "$.path").isNotNull()), F.lit(False))
    return F.coalesce(
        F.when(v.isNull(), "not valid JSON"),
        F.when(~jsons.is_object(v), "a plan is an object"),
        *[F.when(jsons.text_at(v, f"$.{f}").isNull(), f"a plan needs the text {f}") for f in ("name", "description")],
        F.when(~jsons.is_null(v, "$.repository") & jsons.text_at(v, "$.repository").isNull(), "repository must be a text"),
        F.when(~jsons.is_array(v, "$.steps"), "a plan needs a list of steps"),
        F.get(F.filter(F.transform(steps, step_problem), lambda p: p.isNotNull()), F.lit(0)),
        F.when(jsons.kind(v, "$.deliverables").isNotNull() & ~whole, "wrong deliverables"),
    )


def parse_plans(files: DataFrame, *, strict: bool = False) -> DataFrame:
    """(path, plan, error) of ``files(path, format, content)``."""
    block = first_block(F.col("content"))
    markdown = F.col("format").isin("md", "markdown")
    text = files.withColumn("_block", F.when(markdown, block)).withColumn("_text", F.when(markdown, F.col("_block.body")).otherwise(F.col("content")))
    kind = F.when(markdown, F.col("_block.format")).when(F.col("format").isin("yaml", "yml"), "yaml").when(F.col("format") == "json", "json")
    text = text.withColumn("_kind", kind)
    loaded = text.withColumn("_yaml", F.when(F.col("_kind") == "yaml", _yaml_to_json(F.when(F.col("_kind") == "yaml", F.col("_text")))))
    v = jsons.parsed(F.when(F.col("_kind") == "yaml", F.col("_yaml.json")).otherwise(F.col("_text")))
    # bound behind a generator: a filter on the result would else repeat the parsing for each of its uses
    loaded = loaded.select("*", F.explode(F.array(v)).alias("_v"))
    problem = F.coalesce(
        F.when(~F.col("format").isin(*PLAN_FORMATS), F.concat(F.lit("Unsupported format: "), "format")),
        F.when(markdown & F.col("_block").isNull(), "No code block found in markdown"),
        F.col("_yaml.problem"),
        _plan_problem(F.col("_v")),
    )
    checked = loaded.select("path", "_v", F.explode(F.array(problem)).alias("_problem"))
    out = checked.select(
        "path",
        F.when(F.col("_problem").isNull(), F.try_variant_get("_v", "$", PLAN)).alias("plan"),
        F.when(F.col("_problem").isNotNull(), errors.error("workflow.parse", F.col("_problem"))).alias("error"),
    )
    if strict:
        return out.select("path", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("Plan parsing failed: "), "error.message")).cast(PLAN)).otherwise(F.col("plan")).alias("plan"), "error")
    return out


def steps(plans: DataFrame) -> DataFrame:
    """(plan, ord, id, description, action, deps) of parsed plans, one row per step."""
    each = plans.filter("plan is not null").select(F.col("path").alias("plan"), F.posexplode("plan.steps").alias("ord", "s"))
    return each.select("plan", "ord", "s.id", "s.description", "s.action", F.coalesce("s.dependencies", F.array().cast("array<string>")).alias("deps"))


def deliverables(plans: DataFrame) -> DataFrame:
    """(plan, name, description, path) of parsed plans."""
    return plans.filter("plan is not null").select(F.col("path").alias("plan"), F.explode("plan.deliverables").alias("d")).select("plan", "d.name", "d.description", "d.path")
