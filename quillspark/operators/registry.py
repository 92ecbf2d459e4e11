"""Names, profiles, surfaces, availability and settings checks, over registries that come in as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.dimension import as_array
from quillspark.functions.text import slug


def unique_slugs(df: DataFrame, label: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """slug and a collision-free name: later rows of a slug get -2, -3, ..., passing over numbers that another row's own slug
    or taken (column name: names already in use) holds. The first row of a slug keeps it unless it is taken."""
    rows = df.withColumn("slug", slug(F.col(label)))
    held = rows.select(F.col("slug").alias("name"))
    numbered = held if taken is None else held.unionByName(taken.select("name"))
    number = F.regexp_extract("name", r"-([1-9]\d{0,8})$", 1)
    reserved = numbered.filter(number != "").select(F.regexp_extract("name", r"^(.+)-[1-9]\d{0,8}$", 1).alias("_stem"), number.cast("int").alias("_k"))
    if taken is not None:
        reserved = reserved.unionByName(taken.select(F.col("name").alias("_stem"), F.lit(1).alias("_k")))
    stems = rows.groupBy("slug").agg(F.count("*").alias("_rows")).select(F.col("slug").alias("_own"), "_rows")
    # only numbers that a made name could reach
    used = reserved.distinct().join(stems, F.col("_stem") == F.col("_own")).groupBy("_own").agg(F.array_sort(F.collect_set("_k")).alias("_used"))
    joined = rows.join(used, F.col("slug") == F.col("_own"), "left").drop("_own")
    n = F.row_number().over(Window.partitionBy("slug").orderBy(order))
    free = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_n"), lambda k, r: F.when(r <= k, k + 1).otherwise(k))
    named = joined.withColumn("_n", n).withColumn("_free", free)
    return named.withColumn("name", F.when(F.col("_free") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("_free").cast("string")))).drop("_used", "_n", "_free")


def collisions(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n")).filter("n > 1")


def validate_values(df: DataFrame, value: str, accepted: DataFrame, default: str) -> DataFrame:
    """The value if accepted (column name), the default if missing, else an error text."""
    known = accepted.select(F.col("name").alias("_a")).distinct()
    joined = df.join(known, F.col(value) == F.col("_a"), "left")
    blank = F.coalesce(F.trim(value), F.lit("")) == ""
    return joined.withColumns({"resolved": F.when(blank, default).otherwise(F.col("_a")), "error": F.when(~blank & F.col("_a").isNull(), F.concat(F.lit("unknown value: "), F.col(value)))}).drop("_a")


def expand_profiles(profiles: DataFrame, commands: DataFrame, most: int = 16) -> DataFrame:
    """(profile, command) of profiles (profile, includes, commands, categories arrays, all boolean), includes followed; a cycle stops at what it reached.

    The include graph is a few rows; rounds are bounded by most.
    """
    own = profiles.select("profile", F.explode("commands").alias("command"))
    by_category = profiles.select("profile", F.explode("categories").alias("category")).join(commands.select(F.col("name").alias("command"), "category"), "category").select("profile", "command")
    everything = profiles.filter("all").select("profile", F.inline(as_array(commands.select(F.col("name").alias("command")))))
    direct = own.unionByName(by_category).unionByName(everything).distinct()
    edges = profiles.select("profile", F.explode("includes").alias("inner"))
    reach = profiles.select("profile", F.col("profile").alias("inner"))
    front = reach
    for _ in range(most):
        front = front.join(edges.select(F.col("profile").alias("inner"), F.col("inner").alias("_next")), "inner").select("profile", F.col("_next").alias("inner")).distinct().join(reach, ["profile", "inner"], "left_anti")
        if front.isEmpty():
            break
        reach = reach.unionByName(front)
    return reach.join(direct.select(F.col("profile").alias("inner"), "command"), "inner").select("profile", "command").distinct()


def resolve_surfaces(works: DataFrame, base: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """Tier and name of each surface of each work: the work type's tier over its group's, the group's name over the default.

    works: work_type, grp; base: grp, surface, tier; overrides: work_type, surface, tier; names: surface, grp, name (grp default).
    """
    tiers = works.join(base, "grp").join(overrides.select("work_type", "surface", F.col("tier").alias("_o")), ["work_type", "surface"], "left")
    own = names.filter("grp <> 'default'").select("surface", "grp", F.col("name").alias("_g"))
    default = names.filter("grp = 'default'").select("surface", F.col("name").alias("_d"))
    return tiers.join(own, ["surface", "grp"], "left").join(default, "surface", "left").select("work_type", "surface", F.coalesce("_o", "tier").alias("tier"), F.coalesce("_g", "_d", "surface").alias("name"))


def availability(expected: DataFrame, runtimes: DataFrame, found: DataFrame) -> DataFrame:
    """Per runtime: how many expected items (column name; short) are there or missing (found: runtime, name), and the status."""
    grid = runtimes.select("runtime").distinct().select("runtime", F.inline(as_array(expected.select("name").distinct())))
    have = found.select("runtime", "name", F.lit(True).alias("_have")).distinct()
    g = grid.join(have, ["runtime", "name"], "left").groupBy("runtime").agg(F.count("*").alias("expected"), F.count("_have").alias("present"), F.array_sort(F.collect_list(F.when(F.col("_have").isNull(), F.col("name")))).alias("missing"))
    return g.withColumn("status", F.when(F.size("missing") == 0, "ready").when(F.col("present") > 0, "partial").otherwise("missing"))


#: The settings' fields, their kinds, and which may be empty or missing.
SETTINGS = [
    ("version", "string", None, "required"), ("runtime", "string", None, "empty"), ("runtimes", "array", None, "required"), ("scope", "enum", ["global", "project"], "required"), ("developer_mode", "boolean", None, "required"),
    ("data_dir", "string", None, "required"), ("install_mode", "enum", ["interactive", "non-interactive", "silent"], "required"), ("profile", "enum", ["core", "full"], "optional"), ("installed_at", "string", None, "required"),
]


def json_kind(value: Column) -> Column:
    """Kind of a JSON value given as text: string, number, boolean, array, object or null."""
    t = F.trim(value)
    return F.when(value.isNull() | (t == "null"), "null").when(t.startswith("["), "array").when(t.startswith("{"), "object").when(t.isin("true", "false"), "boolean").when(t.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "number").otherwise("string")


def validate_settings(df: DataFrame, json: str, fields=SETTINGS) -> DataFrame:
    """errors and warnings (arrays) of a settings object: missing fields, kinds, enums, empty values; unknown fields only warn."""
    names = [f for f, *_ in fields]
    raw = F.from_json(json, "map<string,string>")
    parsed = df.withColumn("_m", F.when(json_kind(F.col(json)) == "object", raw))
    checks = []
    for name, kind, values, presence in fields:
        v = F.try_element_at(F.col("_m"), F.lit(name))
        has = F.array_contains(F.map_keys("_m"), name) & v.isNotNull()
        wrong = F.lit(False)
        if kind in ("array", "boolean"):
            wrong = json_kind(v) != kind
        elif kind == "enum":
            wrong = ~v.isin(values)
        label = "is not one of its values" if kind == "enum" else f"is not {kind}"
        empty = (kind == "string" and presence == "required") and (F.trim(v) == "")
        check = F.when(~has, f"{name} is missing" if presence != "optional" else None).when(wrong, f"{name} {label}")
        checks.append(check.when(empty, f"{name} is empty") if not isinstance(empty, bool) else check)
    errors = F.when(F.col("_m").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_compact(F.array(*checks)))
    warnings = F.when(F.col("_m").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(F.array_except(F.map_keys("_m"), F.array(*map(F.lit, names)))), lambda k: F.concat(F.lit("unknown field "), k)))
    return parsed.withColumns({"errors": errors, "warnings": warnings}).withColumn("valid", F.size("errors") == 0).drop("_m")


def merge_settings(old: DataFrame, new: DataFrame, key: str, owned: list[str]) -> DataFrame:
    """New values win for owned fields; other fields keep the old value where there is one, and fields that only the old settings have stay."""
    joined = new.alias("n").join(old.alias("o"), key, "left")

    def value(c: str) -> Column:
        if c not in old.columns or c not in new.columns:
            return F.col(f"n.{c}" if c in new.columns else f"o.{c}")
        return F.coalesce(*(f"{side}.{c}" for side in ("no" if c in owned else "on")))

    return joined.select(key, *(value(c).alias(c) for c in dict.fromkeys([*new.columns, *old.columns]) if c != key))


def preserved_copy(source: DataFrame, dest: DataFrame) -> DataFrame:
    """What a copy would do per path (columns path, sha256): fresh, replaced (same hash), backed_up (other hash) or stale (only in dest)."""
    a, b = source.select("path", F.col("sha256").alias("_s")), dest.select("path", F.col("sha256").alias("_d"))
    kind = F.when(F.col("_d").isNull(), "fresh").when(F.col("_s").isNull(), "stale").when(F.col("_s") == F.col("_d"), "replaced").otherwise("backed_up")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind"))


def next_commands_contract(text: Column) -> Column:
    """Text with its closing contract line, once."""
    has = text.rlike(r"(?m)^Next commands:\s*$")
    return F.when(has, text).otherwise(F.concat(F.rtrim(text), F.lit("\n\nNext commands:\n")))


def match_command(df: DataFrame, request: str, keywords: DataFrame) -> DataFrame:
    """First keyword (keywords: priority, keyword, hub; a short table) that a request holds decides its hub."""
    listed = F.array_sort(as_array(keywords, "priority", "keyword", "hub"))
    first = F.get(F.filter(listed, lambda k: F.contains(F.lower(F.col(request)), F.lower(k["keyword"]))), F.lit(0))
    return df.withColumn("hub", first["hub"])
