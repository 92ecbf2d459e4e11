"""Bounded collection of targets in walk order: it stops at the first hard error and keeps what came before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.ranges import RANGES, running
from quillspark.sources.files import ignored

CAPS = {k: rules.LIMITS[k] for k in ("files", "bytes", "depth", "directories")}


def hard_error(caps: dict = CAPS) -> Column:
    """The code of the error at which the walk stops at an entry, or null; needs the running counts _files, _bytes and _dirs."""
    return (
        F.when(F.col("kind") == "scheme", "unsupported_scheme").when(F.col("kind") == "missing", "missing_target").when(F.col("kind").isin("link", "escape"), "unsafe_input")
        .when((F.col("kind") == "dir") & (F.col("depth") > caps["depth"]), "directory_depth_limit").when((F.col("kind") == "dir") & (F.col("_dirs") > caps["directories"]), "directory_count_limit")
        .when((F.col("kind") == "file") & (F.col("_files") > caps["files"]), "file_count_limit").when((F.col("kind") == "file") & (F.col("_bytes") > caps["bytes"]), "input_bytes_limit")
    )


def collect(entries: DataFrame, caps: dict = CAPS, ranges: int = RANGES, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, errors, totals) of entries: target_no (the order of the targets), path, kind, length, depth.

    kind: file, dir (a folder that is entered; the walk's own first folder has depth 0), link, escape (leaves its root), remote (a web address),
    scheme (another address) or missing. The walk takes targets in turn and each in the order of its path's names, a folder
    before what it holds; what ignored folders hold isn't walked. Counts run along the walk; the first entry with a hard error
    ends it, wherever it lies: a file that breaks a cap is still among the files, links and the like are not. Web
    addresses before that are errors that don't stop. files: distinct path and length; errors: code, target (the path of web addresses, else null), at; totals: files and
    bytes of the walk, a file that two targets name counted twice.

    The walk is cut into ranges whose totals give each range its counts, and the stop is a minimum over ranges, so no task sees
    the whole walk.
    """
    walked = entries.filter(~ignored(F.concat("path", F.lit("/")), skip) | F.col("kind").isin("remote", "scheme", "missing"))
    placed = walked.select("*", F.split("path", "/").alias("_names"), F.when(F.col("kind") == "dir", 0).otherwise(1).alias("_late"))
    own = lambda k: F.when(F.col("kind") == k, 1).otherwise(0).cast("long")
    counted = running(placed, [], ["target_no", "_names", "_late"], {"_files": own("file"), "_bytes": F.when(F.col("kind") == "file", F.coalesce("length", F.lit(0))).otherwise(0).cast("long"), "_dirs": own("dir")}, ranges)
    place = F.struct("target_no", "_names", "_late")
    told = counted.withColumns({"_code": hard_error(caps), "_at": place})
    stop = told.filter("_code IS NOT NULL").agg(F.min(F.struct("_at", "_code", "path")).alias("s")).first()["s"]
    if stop is None:
        kept, ends = told, None
    else:
        at = F.struct(F.lit(stop["_at"]["target_no"]).cast(entries.schema["target_no"].dataType).alias("target_no"), F.array(*map(F.lit, stop["_at"]["_names"])).alias("_names"), F.lit(stop["_at"]["_late"]).alias("_late"))
        kept, ends = told.filter(F.col("_at") <= at), (stop["_code"], stop["path"])
    counts = kept.filter("kind = 'file'")
    files = counts.groupBy("path").agg(F.max("length").alias("length"))
    spark = entries.sparkSession
    soft = kept.filter("kind = 'remote'").select(F.lit("remote_unsupported").alias("code"), F.col("path").alias("target"), F.col("path").alias("at"))
    errors = soft.unionByName(spark.createDataFrame([(ends[0], None, ends[1])], "code string, target string, at string")) if ends else soft
    return files, errors, counts.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))


def listing(files: DataFrame, root: str, target_no: int = 0) -> DataFrame:
    """Entries of a read tree (rel_path, length): its files and the folders that hold them, each folder once."""
    names = F.split("rel_path", "/")
    depth = F.size(names)
    own = files.select(F.col("rel_path").alias("path"), F.lit("file").alias("kind"), "length", depth.alias("depth"))
    above = files.select(F.explode(F.sequence(F.lit(0), depth - 1)).alias("depth"), names.alias("n")).select(F.array_join(F.slice("n", F.lit(1), F.col("depth")), "/").alias("path"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("length"), "depth").distinct()
    joined = own.unionByName(above.select("path", "kind", "length", "depth"))
    full = F.when(F.col("path") == "", F.lit(root.rstrip("/"))).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "path"))
    return joined.select(F.lit(target_no).alias("target_no"), full.alias("path"), "kind", "length", "depth")


def order_of(entries: DataFrame) -> Window:
    """The walk's order as a window over a small table, for tests and reports."""
    return Window.orderBy("target_no", F.split("path", "/"), F.when(F.col("kind") == "dir", 0).otherwise(1))
