"""Reading and writing tables, nested JSON, file manifests and event feeds."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labframe.sources.schema import TableSpec

#: What an uploaded image may be.
IMAGE_TYPES, IMAGE_BYTES = ("image/jpeg", "image/png", "image/webp"), 2 * 1024 * 1024


#: Where stored tables lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """A table with its declared schema; columns that nobody asks for are not read."""
    return spark.read.schema(spec.struct).parquet(path)


def read_jdbc(spark: SparkSession, url: str, spec: TableSpec, partitions: int = 8, **options: str) -> DataFrame:
    """The same from a database, in ranges of the key between its least and greatest value (needs the database's driver on the class path).

    Filters and the columns asked for are sent to the database. An empty table is one range.
    """
    columns = {f.name for f in spec.struct.fields}
    key = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(spec.key)
    bounds = spark.read.jdbc(url, f"(SELECT MIN({key}) AS low, MAX({key}) AS high FROM {spec.name}) bounds_", properties=options).first()
    low, high = (0, 0) if bounds[0] is None else (int(bounds[0]), int(bounds[1]))
    out = spark.read.jdbc(url, spec.name, column=spec.key, lowerBound=low, upperBound=high + 1, numPartitions=max(1, min(partitions, high - low + 1)), properties=options)
    names = {c.lower(): c for c in out.columns}
    return out.select(*(F.col(names[f.name.lower()]).cast(f.dataType).alias(f.name) for f in spec.struct.fields if f.name in columns))


def write_jdbc(df: DataFrame, url: str, spec: TableSpec, types: str, **options: str) -> None:
    """Writes a table anew, with the database's own column types."""
    df.write.option("createTableColumnTypes", types).jdbc(url, spec.name, mode="overwrite", properties=options)


def as_text(schema: T.StructType) -> T.StructType:
    """The schema with every leaf as a string, so that a bad leaf becomes a rule's error and not a null row."""

    def leaf(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.StructType):
            return as_text(kind)
        return T.ArrayType(leaf(kind.elementType)) if isinstance(kind, T.ArrayType) else T.StringType()

    return T.StructType([T.StructField(f.name, leaf(f.dataType)) for f in schema.fields])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(as_text(schema)).json(path)


def parsed(df: DataFrame, column: str, schema: T.StructType, to: str = "record") -> DataFrame:
    """JSON text to a record of text leaves; properties outside the schema vanish. `present`: the properties that were there, null ones too."""
    return df.withColumn(to, F.from_json(F.col(column), as_text(schema))).withColumn("present", F.json_object_keys(F.col(column)))


def json_split(df: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows with the fields of their JSON text in place of it, rows whose text is no object of this schema, as they are)."""
    corrupt = "text that is no record"
    record = F.from_json(F.col(column), T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    rows = df.withColumn("record_", record)
    bad = F.col("record_").isNull() | F.col("record_")[corrupt].isNotNull()
    rest = [c for c in df.columns if c != column]
    return rows.where(~bad).select(*(F.col("record_")[f.name].alias(f.name) for f in schema.fields), *rest), rows.where(bad).select(*df.columns)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A stream of the files of a folder; one file has to be named by a pattern that it matches."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def file_fault(mime: Column, length: Column, required: bool = True, types: tuple[str, ...] = IMAGE_TYPES, most: int = IMAGE_BYTES) -> Column:
    """The first fault of an uploaded file, or null: MISSING, TYPE, SIZE."""
    gone = mime.isNull() | length.isNull()
    return F.when(gone, F.lit("MISSING") if required else F.lit(None)).when(~mime.isin(*types), "TYPE").when(length > most, "SIZE")


#: The bytes that files of these types begin with (a webp file has its mark after a length).
MAGIC = {"image/jpeg": "^ffd8ff", "image/png": "^89504e470d0a1a0a", "image/webp": "^52494646........57454250"}


def read_manifest(spark: SparkSession, path: str, most: int = IMAGE_BYTES) -> DataFrame:
    """(path, length, modified, magic) of all files below a folder: names and sizes from the listing, and the type that a file's first bytes tell.

    Files over `most` bytes are listed, but never opened. Files without a byte are not listed, so they count as missing.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.lower(F.hex(F.substring("content", 1, 12)))
    kind = F.coalesce(*(F.when(head.rlike(pattern), mime) for mime, pattern in MAGIC.items()))
    opened = found.where(F.col("length") <= most).select("path", "length", F.col("modificationTime").alias("modified"), kind.alias("magic"))
    large = found.where(F.col("length") > most).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(None).cast("string").alias("magic"))
    return opened.unionByName(large)


def manifest_faults(stated: DataFrame, manifest: DataFrame, required: bool = True, most: int = IMAGE_BYTES) -> DataFrame:
    """stated (path, mime, ...) with the first fault or null: MISSING (no such file), TYPE, SIZE, CONTENT (the bytes are of another type)."""
    out = stated.join(manifest.select("path", "length", "magic"), "path", "left")
    fault = F.coalesce(file_fault(F.col("mime"), F.col("length"), required, most=most), F.when(F.col("length").isNotNull() & ~F.col("mime").eqNullSafe(F.col("magic")), "CONTENT"))
    return out.select(*stated.columns, "length", fault.alias("fault"))


def with_defaults(df: DataFrame, spec: TableSpec, as_of: Column) -> DataFrame:
    """The batch with the table's defaults for nulls, and its times set."""
    types = {f.name: f.dataType for f in spec.struct.fields}
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(types[c])) if c in df.columns else F.lit(v).cast(types[c]) for c, v in spec.defaults.items() if c in types})
    return out.withColumns({c: as_of for c in ("createdAt", "updatedAt") if c in types})


def header_and_lines(df: DataFrame, children: str, key: str = "id", parent: str = "parentId") -> tuple[DataFrame, DataFrame]:
    """A batch of records with a child array, as two frames to append: headers and numbered children."""
    lines = df.select(F.col(key).alias(parent), F.posexplode(children).alias("position", "child")).select(parent, "position", "child.*")
    return df.drop(children), lines


def appended(df: DataFrame, path: str, batch: str) -> None:
    """Appends under the batch's own folder, so that a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in that of spark.checkpoint.dir, which goes when the application ends; a local session without the setting gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="labframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/labframe-{spark.sparkContext.applicationId}")
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(own)
    files.deleteOnExit(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read again, which cuts its lineage and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def folder_of(table: DataFrame) -> str:
    """Where a stored table lies."""
    return _PATHS[table]


def discarded(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
