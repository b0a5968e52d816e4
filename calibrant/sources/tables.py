"""Readers, writers, ledgers and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; where it is unset on one machine (a local master) a
    temporary folder, set once. On a cluster without it: ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("calibrant.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="calibrant-")
        spark.conf.set("calibrant.shared.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, label: str = "cut", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the values of ``by``, and read it back, so that its lineage ends and it is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_files(df: DataFrame) -> None:
    """Delete the table that :func:`cut` returned; nothing may read it afterwards."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """A1: raises before any job when columns are missing."""
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, required: tuple[str, ...] = (), sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """A1: CSV or TSV with a header (separator by the name's ending unless given). With a schema nothing is inferred;
    without one every column is text. Quoted line breaks need ``multi_line``, which reads each file in one task."""
    sep = sep or ("\t" if path.rstrip("/").endswith((".tsv", ".tsv.gz")) else ",")
    r = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    return require_columns((r.schema(schema) if schema is not None else r).csv(path), *required)


def read_many(spark: SparkSession, paths: list[str], tag: str = "source_file", required: tuple[str, ...] = (), exclude_prefix: str = "INCORRECT_") -> DataFrame:
    """The union by name of those files that exist and hold rows, each row tagged with its file's name; names
    that start with ``exclude_prefix`` are left out. Raises when nothing is left."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = None
    for path in paths:
        p = hadoop.Path(path)
        if p.getName().startswith(exclude_prefix) or not p.getFileSystem(conf).exists(p):
            continue
        df = read_table(spark, path, required=required)
        df = df.select("*", F.col("_metadata.file_name").alias(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"none of {len(paths)} inputs can be read")
    return out


def keyed_files(df: DataFrame, pattern: str = r"^(.*?)\.[^.]+$", name: str = "entity_id") -> DataFrame:
    """Adds the entity id taken from each row's file name."""
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias(name))


def read_json_records(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A3, A4: JSON files that are a list of records, or an object with ``data`` (records with attributes) or
    ``activities``: one row per record, id from ``id`` or ``attributes.id``."""
    r = spark.read.option("multiLine", multi_line)
    df = (r.schema(schema) if schema else r).json(path)
    for name in ("data", "activities"):
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            df = df.select(F.explode(name).alias("r")).select("r.*")
    if "attributes" in df.columns:
        inner = df.schema["attributes"].dataType.names
        ids = [F.col(c).cast("string") for c in (["id"] if "id" in df.columns else [])] + ([F.col("attributes.id").cast("string")] if "id" in inner else [])
        df = df.select(*([F.coalesce(*ids).alias("id")] if ids else []), *[F.col(f"attributes.{c}").alias(c) for c in inner if c != "id"])
    return df


def scan_sdf_properties(spark: SparkSession, path: str, with_index: bool = False) -> DataFrame:
    """A5: one row per ``$$$$`` record: source_file, title, tags (map of the first value line of each tag).

    Without the index the files are split by record. With it (record_index within the file) each file is read whole, so
    it must fit in a row.
    """
    if with_index:
        text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source_file"), F.posexplode(F.split("value", r"\$\$\$\$\r?\n?")).alias("record_index", "value"))
    else:
        text = spark.read.text(path, lineSep="$$$$\n").select(F.col("_metadata.file_name").alias("source_file"), F.lit(None).cast("int").alias("record_index"), "value")
    tag = r">[^<\n]*<([^>\n]+)>[^\n]*\n([^\n]*)"
    names, values = F.regexp_extract_all("value", F.lit(tag), F.lit(1)), F.regexp_extract_all("value", F.lit(tag), F.lit(2))
    first = F.transform(F.array_distinct(names), lambda n: F.trim(F.get(values, (F.array_position(names, n) - 1).cast("int"))))
    return text.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select("source_file", "record_index", F.split_part("value", F.lit("\n"), F.lit(1)).alias("title"), F.map_from_arrays(F.array_distinct(names), first).alias("tags"))


def scan_fixed_width_atoms(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB text files: the first model only, ATOM and HETATM, alternate location blank, A or 1, rows whose
    coordinates parse; the element falls back to the first letter of the atom's name. One file is one structure."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.[^.]+$", "").alias("structure_id"), F.split_part("value", F.lit("ENDMDL"), F.lit(1)).alias("value"))
    line = whole.select("structure_id", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "l")).where(F.substring("l", 1, 6).isin("ATOM  ", "HETATM"))
    part = lambda a, n: F.trim(F.substring("l", a, n))
    num = lambda a: part(a, 8).try_cast("double")
    atoms = line.select(
        "structure_id", "line_no", part(1, 6).alias("record_group"), part(13, 4).alias("atom_name"), part(17, 1).alias("alt"), part(18, 3).alias("residue_name"), part(22, 1).alias("chain"),
        part(23, 4).alias("residue_id"), part(27, 1).alias("insertion_code"), num(31).alias("x"), num(39).alias("y"), num(47).alias("z"), part(77, 2).alias("e"),
    )
    element = F.when(F.col("e") != "", F.upper("e")).otherwise(F.upper(F.regexp_extract("atom_name", "[A-Za-z]", 0)))
    return atoms.where(F.col("alt").isin("", "A", "1") & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).withColumn("element", element).drop("e", "alt")


def file_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, bytes, sha256 of every file (below 2 GiB each)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def table_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, bytes, sha256 of every entry of a folder. A file's digest is that of its bytes; a folder's (a table in parts) that of its files'
    names and digests in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    depth = len(root.split("/"))
    parts = F.split("path", "/")
    files = file_ledger(spark, path).select(F.get(parts, F.lit(depth)).alias("name"), F.array_join(F.slice(parts, F.lit(depth + 2), F.size(parts)), "/").alias("inner"), "bytes", "sha256")
    each = F.sort_array(F.collect_list(F.struct("inner", "sha256")))
    digest = F.when((F.count(F.lit(1)) == 1) & (F.max("inner") == ""), F.max("sha256")).otherwise(F.sha2(F.array_join(F.transform(each, lambda x: F.concat_ws("\x1f", x["inner"], x["sha256"])), "\x1e"), 256))
    return files.groupBy("name").agg(F.sum("bytes").alias("bytes"), digest.alias("sha256")).select(F.concat(F.lit(root + "/"), "name").alias("path"), "name", "bytes", "sha256")


def check_ledger(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    """Name, status: ok, mismatch, missing or unexpected against pinned digests (name, sha256)."""
    m = manifest.select("name", F.col("sha256").alias("pinned"))
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("pinned").isNull(), "unexpected").when(F.col("sha256") != F.col("pinned"), "mismatch").otherwise("ok")
    return ledger.join(m, "name", "full_outer").select("name", status.alias("status"))


def incremental_inputs(new: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose (path, sha256) was not processed before."""
    return new.join(done.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")


def table_digest(df: DataFrame, name: str, version: str = "1") -> DataFrame:
    """One row: table, version, rows and a digest that doesn't depend on the rows' order: the sum of 60 bits of each row's SHA-256 over its
    values as text, parted by unit separators, null as a single escape. Other engines can compute it too."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1b")) for c in df.columns])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest")).select(F.lit(name).alias("table"), F.lit(version).alias("version"), "rows", "digest")


def run_manifest(**tables: DataFrame) -> DataFrame:
    """A digest row for each table of a run."""
    rows = [table_digest(df, name) for name, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def write_outputs(path: str, order: list[str], **tables: DataFrame) -> None:
    """A10: each table as Parquet below ``path``, sorted within its parts by those of ``order`` that it has."""
    for name, df in tables.items():
        keys = [c for c in order if c in df.columns]
        (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def stable_prefix(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows by an explicit total order."""
    return df.orderBy(*order).limit(n)
