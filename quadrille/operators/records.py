"""Provenance of files and runs: digests, manifests and what changed, nested differences, named checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: files above this size keep the digest of an earlier manifest instead of being read again.
LARGE_BYTES = 100 * 1024 * 1024


#: Bytes of a file that are read at a time.
CHUNK_BYTES = 4 << 20


def _sha256(path: str, chunk: int) -> str:
    import pyarrow.fs as pafs

    fs, local = pafs.FileSystem.from_uri(path)
    state = hashlib.sha256()
    with fs.open_input_stream(local) as source:
        while data := source.read(chunk):
            state.update(data)
    return state.hexdigest()


def digests(spark: SparkSession, path: str, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(path, size, modified, sha256) of all files under ``path``; each is read by one task, ``chunk`` bytes at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    own = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for paths in batches:
            yield pa.array([_sha256(p, chunk) for p in paths.to_pylist()], pa.string())

    return own.withColumn("sha256", F.arrow_udf(digest, "string")("path"))


def reused(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, size, modified, sha256): the manifest's digest where path, size and time agree, else null (to be read)."""
    known = manifest.select("path", "size", "modified", "sha256")
    return files.select("path", "size", "modified").join(known, ["path", "size", "modified"], "left")


def manifest(files: DataFrame, known: DataFrame, read: DataFrame, large: int = LARGE_BYTES) -> DataFrame:
    """(path, size, sha256, origin) for all ``files``.

    Digests come from ``known`` where size and time agree (``kept``); else from ``read`` (``read``);
    files of ``large`` bytes or more that changed are not read and have none (``large``).
    """
    old = reused(files, known)
    new = read.select("path", F.col("sha256").alias("fresh"))
    big = F.col("size") >= large
    found = old.join(new, "path", "left")
    origin = F.when(F.col("sha256").isNotNull(), "kept").when(big, "large").otherwise("read")
    return found.select("path", "size", F.coalesce("sha256", F.when(~big, F.col("fresh"))).alias("sha256"), origin.alias("origin"))


def manifest_changes(old: DataFrame, new: DataFrame, present: DataFrame) -> DataFrame:
    """(path, grp, state, fields) of the entries of ``old`` that aren't in ``new`` as they were.

    An entry is sought by path and group, then by path alone. ``changed`` lists the fields that
    differ; without any entry it is ``gone`` or, if the file is still ``present``, ``uncovered``.
    """
    exact = new.select("path", "grp", F.struct("sha256", "size", "grp").alias("same"))
    by_path = new.groupBy("path").agg(F.min_by(F.struct("sha256", "size", "grp"), "grp").alias("other"))
    both = old.join(exact, ["path", "grp"], "left").join(by_path, "path", "left").withColumn("now", F.coalesce("same", "other"))
    both = both.join(present.select("path").distinct().withColumn("there", F.lit(True)), "path", "left")
    fields = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("now")[c]), c) for c in ("sha256", "size", "grp")]))
    state = F.when(F.col("now").isNull(), F.when(F.col("there"), "uncovered").otherwise("gone")).when(F.size(fields) > 0, "changed")
    return both.select("path", "grp", state.alias("state"), F.when(F.col("now").isNotNull(), fields).otherwise(F.array().cast("array<string>")).alias("fields")).filter("state is not null")


def manifest_faults(entries: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, grp, faults) of entries with any: repeated under one group, absent, of another size, or not root plus rest."""
    n = entries.groupBy("path", "grp").agg(F.count("*").alias("n"))
    both = entries.join(n, ["path", "grp"]).join(files.select("path", F.col("size").alias("found")), "path", "left").join(F.broadcast(roots.select(F.col("root").alias("root"), "folder")), "root", "left")
    whole = F.concat(F.col("folder"), F.lit("/"), F.col("rest"))
    checks = {"repeated": F.col("n") > 1, "absent": F.col("found").isNull(), "size": F.col("found") != F.col("size"), "root": ~whole.eqNullSafe(F.col("path"))}
    return both.select("path", "grp", failed(checks).alias("faults")).filter("size(faults) > 0").distinct()


def longest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, root, rest): the longest root folder that holds a path, ``FS`` if none does.

    A path has as many folders above it as slashes; each is looked up, so roots are joined by equality.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    held = paths.select("path", F.explode(above).alias("folder")).join(roots.select("root", "folder"), "folder")
    best = held.groupBy("path").agg(F.max_by(F.struct("root", "folder"), F.length("folder")).alias("b"))
    rest = F.when(F.col("b").isNull(), F.ltrim(F.col("path"), F.lit("/"))).otherwise(F.substr("path", F.length("b.folder") + 2))
    return paths.join(best, "path", "left").select("path", F.coalesce("b.root", F.lit("FS")).alias("root"), rest.alias("rest"))


def _flat(value, at: str = "") -> Iterator[tuple[str, str, str | None, float | None]]:
    if isinstance(value, dict):
        yield at, "object", ",".join(sorted(value)), None
        for k, v in value.items():
            yield from _flat(v, f"{at}/{k}")
    elif isinstance(value, list):
        yield at, "array", str(len(value)), None
        for i, v in enumerate(value):
            yield from _flat(v, f"{at}[{i}]")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        yield at, "number", None, float(value)
    else:
        yield at, "other", json.dumps(value), None


def flattened(records: DataFrame, key: str, record: str) -> DataFrame:
    """(key, at, kind, text, number): a row a value of JSON texts, wherever it stands; null texts have none."""

    def flat(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("at", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("number", pa.float64())]))
        for column in columns:
            yield pa.array([None if x is None else [dict(zip(("at", "kind", "text", "number"), v, strict=True)) for v in _flat(json.loads(x))] for x in column.to_pylist()], kind)

    flat_ = F.arrow_udf(flat, "array<struct<at:string,kind:string,text:string,number:double>>")
    return records.select(key, F.explode(flat_(F.col(record))).alias("v")).select(key, "v.*")


def deep_differences(left: DataFrame, right: DataFrame, key: str, record: str) -> DataFrame:
    """(key, differing, numbers, max_abs): how nested records differ.

    Objects differ by their keys, arrays by their length, numbers and other values by themselves;
    values that only one side has are told by their object or array. Both sides are shuffled: Spark takes a
    record's values for one row, so that by its estimate it would broadcast tables of any size.
    """
    a = flattened(left, key, record).select(key, "at", F.struct("kind", "text", "number").alias("a"))
    b = flattened(right, key, record).select(key, "at", F.struct("kind", "text", "number").alias("b"))
    both = a.join(b.hint("merge"), [key, "at"])
    number = (F.col("a.kind") == "number") & (F.col("b.kind") == "number")
    gap = F.when(number, F.abs(F.col("a.number") - F.col("b.number")))
    return both.groupBy(key).agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differing"), F.count_if(number).alias("numbers"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_abs"))


def failed(checks: dict[str, Column]) -> Column:
    """The names of the conditions that hold, in order; unknown ones don't."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in checks.items()]))


def chained(notes: DataFrame) -> DataFrame:
    """(note, cites, predecessor): which note each text cites by a SHA-256, null if no note has it."""
    cited = notes.select("note", F.regexp_extract("text", r"\b([0-9a-f]{64})\b", 1).alias("cites"))
    known = notes.select(F.col("note").alias("predecessor"), F.col("sha256").alias("cites"))
    return cited.join(known, "cites", "left").select("note", F.when(F.col("cites") != "", F.col("cites")).alias("cites"), "predecessor")


def sheet(runs: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, name, one, least, middle, most): a value that all runs share, or the range of those they have."""
    held = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns]))
    per = runs.select(group, held.alias("v")).select(group, "v.*").groupBy(group, "name", "x").agg(F.count("*").alias("n"))
    out = per.groupBy(group, "name").agg(F.count("*").alias("values"), F.min("x").alias("least"), F.expr("percentile(x, 0.5D, n)").alias("middle"), F.max("x").alias("most"))
    single = F.col("values") == 1
    return out.select(group, "name", F.when(single, F.col("least")).alias("one"), *[F.when(~single, F.col(c)).alias(c) for c in ("least", "middle", "most")])
