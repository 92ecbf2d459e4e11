"""File trees as DataFrames, with ignored folders, scopes, caps and errors as data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import rules

SCOPES = {"source": ["drafts", "front-matter", "back-matter", "marketing"], "build": ["build"], "output": ["output"], "all": ["drafts", "front-matter", "back-matter", "marketing", "build", "output"]}


def ignored(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a folder on the path is one of those that are never read."""
    names = "|".join(n.replace(".", r"\.") for n in (*rules.IGNORED_DIRS, *extra))
    return path.rlike(f"(?:^|/)(?:{names})/")


def read_tree(spark: SparkSession, root: str, glob: str = "*", skip: tuple[str, ...] = ()) -> DataFrame:
    """path, rel_path, name, ext, length, modified, content of every file below root that no ignored folder holds."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    # the root as it stands in a path, without scheme and host: what follows its first occurrence lies below it
    own = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "", root).rstrip("/") + "/"
    own = own if own.startswith("/") else f"/{own.removeprefix('./')}"
    below = F.substring(F.col("path"), F.instr(F.col("path"), own) + len(own), F.length("path"))
    tree = raw.select("path", below.alias("rel_path"), F.col("length"), F.col("modificationTime").alias("modified"), "content")
    return tree.filter(~ignored(F.col("rel_path"), skip)).withColumns({"name": F.element_at(F.split("rel_path", "/"), -1), "ext": F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1))})


def in_scope(df: DataFrame, scope: str) -> DataFrame:
    """Files of a scope's folders; an unknown scope is an error."""
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope}; there are {', '.join(SCOPES)}")
    return df.filter(F.split("rel_path", "/")[0].isin(SCOPES[scope]))


def listed(df: DataFrame, folder: str, exts: list[str] | None = None, recursive: bool = True) -> DataFrame:
    inside = F.col("rel_path").rlike(f"^{folder}/" + ("" if recursive else "[^/]+$"))
    return df.filter(inside & F.col("ext").isin(exts)) if exts else df.filter(inside)


def over_limits(df: DataFrame, limits: dict = rules.LIMITS) -> DataFrame:
    """Error rows (code, target, message): files over the size of one object, paths over the depth, and, where asked for, run totals."""
    large = df.filter(F.col("length") > limits["bytes"]).select(F.lit("file_too_large").alias("code"), F.col("rel_path").alias("target"), F.concat(F.lit("File exceeds "), F.lit(str(limits["bytes"])), F.lit(" bytes.")).alias("message"))
    deep = df.filter(F.size(F.split("rel_path", "/")) > limits["depth"]).select(F.lit("depth_limit").alias("code"), F.col("rel_path").alias("target"), F.lit("Path is too deep.").alias("message"))
    return large.unionByName(deep)


def run_totals(df: DataFrame, limits: dict = rules.LIMITS) -> DataFrame:
    """One row: files, bytes and whether the run's optional caps hold."""
    return df.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("within", (F.col("files") <= limits["files"]) & (F.col("bytes") <= limits["bytes"]))


def target_kind(target: Column) -> Column:
    """local, remote_unsupported (web addresses) or scheme_unsupported."""
    return F.when(target.rlike("(?i)^https?://"), "remote_unsupported").when(target.rlike("(?i)^[a-z][a-z0-9+.-]+:"), "scheme_unsupported").otherwise("local")


def texts(df: DataFrame) -> DataFrame:
    """Files as text; those that aren't UTF-8 or hold NUL are null."""
    s = F.col("content").cast("string")
    return df.withColumn("text", F.when(F.is_valid_utf8(s) & ~s.contains("\0"), s))


def parsed_json(text: Column, schema: str) -> Column:
    """Null on a missing or broken text."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Voice fixtures of one JSON document with an array of them."""
    schema = "fixtures array<struct<id string, sample string, expected_pass boolean, min_markers int, max_forbidden int, required_markers array<string>, forbidden_patterns array<string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("fixtures").alias("f")).select("f.*")


def command_inventory(df: DataFrame, root: str = "commands") -> DataFrame:
    """ref and description of command texts (rel_path, text): the ref is the path below root with : for /."""
    from quillspark.operators.metadata import front_matter_values

    own = df.filter((F.col("rel_path").startswith(f"{root}/")) & F.col("rel_path").endswith(".md")).withColumn("ref", F.replace(F.regexp_replace("rel_path", rf"^{root}/|\.md$", ""), F.lit("/"), F.lit(":")))
    values = front_matter_values(own, "ref").filter("key = 'description'").select("ref", F.col("value").alias("description"))
    return own.select("ref").join(values, "ref", "left")


def profile_listing(df: DataFrame, root: str) -> DataFrame:
    """Folders below root with a safe name and a manifest."""
    return df.filter(F.col("rel_path").rlike(f"^{root}/[a-z0-9](?:[a-z0-9-]*[a-z0-9])?/manifest\\.ya?ml$")).select(F.split("rel_path", "/")[1].alias("name")).distinct()
