"""Tables that change by whole versions: a manifest names the segments of a version, and the commit of one is atomic.

A commit adds a segment: new rows of any of the tables, and the keys (collection, doc) whose older rows are gone with it.
Nothing that an older version reads is touched. The version comes into being when its manifest is renamed into place, which
fails if another writer was first; then the commit is made again on top of that version. A writer that dies leaves files that
no manifest names. A reader holds the list of segments of one version, so it never sees half of a commit.

Rows lie in folders by segment, collection and bucket of the document, so a read of some collections or documents lists
and opens no others; files carry Bloom filters of their documents.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from folioloom.operators.tables import BROADCAST_ROWS, delete

#: Folders that a collection's documents are dealt to, in each segment, and tasks that write one of them.
BUCKETS, SPREAD = 8, 8
#: Columns of the folders; a collection's name stands in the rows too, so its type stays what it is.
AT_SEGMENT, AT_COLLECTION, AT_BUCKET = "at_segment", "at_collection", "at_bucket"
#: The table of keys that are gone.
GONE = "gone"
#: Commits tried again after another writer was first, and segments beyond which a commit merges all.
TRIES, SEGMENTS = 10, 16
#: Collections or documents that a filter names one by one.
NAMED = 1000


#: A table's rows, or how they are made of the segment's tables before it, which are written by then.
Rows = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


class Conflict(Exception):
    """Another writer has made the version already."""


class Segment(NamedTuple):
    """id: its folder; no: the version that added it; rows: number of rows by table."""

    id: str
    no: int
    rows: dict[str, int]


class Version(NamedTuple):
    """schemas: the tables' columns as JSON; tables in `added` hold changes that add up, and their rows never go."""

    no: int
    segments: tuple[Segment, ...]
    schemas: dict[str, str]
    added: tuple[str, ...]


EMPTY = Version(0, (), {}, ())


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(path: str, no: int) -> str:
    return f"{path}/_versions/{no:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions that are kept, rising."""
    place, system = _file_system(spark, f"{path}/_versions")
    if not system.exists(place):
        return []
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))


def version(spark: SparkSession, path: str, no: int | None = None) -> Version:
    """A version, the latest one by default; of a store that isn't there, one without rows."""
    if no is None:
        held = versions(spark, path)
        if not held:
            return EMPTY
        no = held[-1]
    place, system = _file_system(spark, manifest(path, no))
    stream = system.open(place)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(no, tuple(Segment(s["id"], s["no"], s["rows"]) for s in said["segments"]), said["schemas"], tuple(said["added"]))


def publish(spark: SparkSession, path: str, new: Version) -> None:
    """Makes a version the latest one, at once or not at all: Conflict if its number is taken."""
    said = {"segments": [s._asdict() for s in new.segments], "schemas": new.schemas, "added": new.added}
    place, system = _file_system(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = system.create(place, False)
    try:
        out.write(bytearray(json.dumps(said).encode()))
    finally:
        out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    never_over = spark.sparkContext._gateway.new_array(options, 1)
    never_over[0] = options.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(place, spark._jvm.org.apache.hadoop.fs.Path(manifest(path, new.no)), never_over)
    except Exception as error:
        system.delete(place, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(new.no) from None
        raise


def folder_of(collection: Column) -> Column:
    return F.concat(F.lit("c_"), collection.cast("string"))


def bucket_of(doc: Column) -> Column:
    return F.pmod(F.xxhash64(doc.cast("string")), F.lit(BUCKETS)).cast("int")


def placed(rows: DataFrame) -> DataFrame:
    """rows (collection, doc or none, ...) with the columns of their folders."""
    bucket = bucket_of(F.col("doc")) if "doc" in rows.columns else F.lit(0)
    return rows.withColumns({AT_COLLECTION: folder_of(F.col("collection")), AT_BUCKET: bucket})


def put(path: str, segment: str, tables: dict[str, Rows]) -> tuple[dict[str, int], dict[str, str]]:
    """Writes a segment's tables in order; their numbers of rows and schemas. Rows are dealt by folder and by hash within a folder, so a
    collection that holds most rows isn't one task's."""
    rows, schemas, written = {}, {}, {}
    for name, own in tables.items():
        df = own(written) if callable(own) else own
        spread = F.pmod(F.xxhash64(*(c for c in ("doc", "term") if c in df.columns)), F.lit(SPREAD))
        own = placed(df).repartition(AT_COLLECTION, AT_BUCKET, spread)
        writer = own.write.partitionBy(AT_COLLECTION, AT_BUCKET)
        if "doc" in df.columns:
            writer = writer.option("parquet.bloom.filter.enabled#doc", "true").option("parquet.bloom.filter.expected.ndv#doc", "100000")
        place = f"{path}/{name}/{AT_SEGMENT}={segment}"
        writer.parquet(place)
        schemas[name] = df.schema.json()
        written[name] = df.sparkSession.read.schema(StructType([*df.schema, *_FOLDERS[1:]])).parquet(place)
        rows[name] = written[name].count()  # from the files' footers
    return rows, schemas


_FOLDERS = [StructField(AT_SEGMENT, StringType()), StructField(AT_COLLECTION, StringType()), StructField(AT_BUCKET, IntegerType())]


def stored(spark: SparkSession, path: str, at: Version, name: str) -> DataFrame:
    """The rows of a table as its segments hold them, with the columns of the folders."""
    schema = StructType.fromJson(json.loads(at.schemas[name]))
    schema = StructType([StructField(f.name, f.dataType, True) for f in schema] + _FOLDERS)
    places = [f"{path}/{name}/{AT_SEGMENT}={s.id}" for s in at.segments if s.rows.get(name)]
    if not places:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{name}").parquet(*places)


def numbered(rows: DataFrame, at: Version) -> DataFrame:
    """rows with at_no, the version that added their segment."""
    pairs = [F.lit(x) for s in at.segments for x in (s.id, s.no)]
    return rows.withColumn("at_no", F.element_at(F.create_map(*pairs), F.col(AT_SEGMENT)) if pairs else F.lit(0))


def live(spark: SparkSession, path: str, name: str, at: Version | None = None, collections: Iterable | None = None, docs: Iterable | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The rows of a table in a version, without those that later segments replaced or deleted. collections, docs: only these
    (some, by name); wanted: only the keys (collection, doc) in it. Folders that hold none of them are neither listed nor read.
    """
    at = version(spark, path) if at is None else at
    if name not in at.schemas:
        raise KeyError(f"no table {name} in version {at.no} of {path}")
    keep = None
    if collections is not None:
        keep = F.col(AT_COLLECTION).isin([f"c_{c}" for c in collections])
    if docs is not None:
        named = list(docs)
        # the folder of a document is known beforehand, its place in a file from the file's Bloom filter
        own = F.col("doc").isin(named) & F.col(AT_BUCKET).isin([r[0] for r in spark.createDataFrame([(str(x),) for x in named], "doc string").select(bucket_of(F.col("doc"))).distinct().collect()])
        keep = own if keep is None else keep & own
    rows = stored(spark, path, at, name)
    rows = rows if keep is None else rows.filter(keep)
    if wanted is not None:
        rows = reduced(rows, wanted)
    if name not in at.added and (n_gone := sum(s.rows.get(GONE, 0) for s in at.segments)):
        gone = stored(spark, path, at, GONE)
        gone = gone if keep is None else gone.filter(keep)
        gone = gone if wanted is None else reduced(gone, wanted)
        last = numbered(gone, at).groupBy(AT_COLLECTION, AT_BUCKET, F.col("doc").alias("gone_doc")).agg(F.max("at_no").alias("gone_no"))
        last = F.broadcast(last) if n_gone <= BROADCAST_ROWS else last
        rows = numbered(rows, at).withColumnRenamed("at_no", "own_no")
        later = (rows[AT_COLLECTION] == last[AT_COLLECTION]) & (rows[AT_BUCKET] == last[AT_BUCKET]) & (rows["doc"] == last["gone_doc"]) & (last["gone_no"] > rows["own_no"])
        rows = rows.join(last, later, "left_anti").drop("own_no")
    return rows.drop(AT_SEGMENT, AT_COLLECTION, AT_BUCKET)


def reduced(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose key is among those wanted (collection, doc); of few folders, only these are read."""
    keys = placed(wanted.select("collection", "doc")).select(AT_COLLECTION, AT_BUCKET, F.col("doc").alias("wanted_doc"))
    folders = keys.select(AT_COLLECTION, AT_BUCKET).distinct().limit(NAMED + 1).collect()
    if len(folders) <= NAMED:
        rows = rows.filter(F.col(AT_COLLECTION).isin(sorted({f[0] for f in folders})) & F.col(AT_BUCKET).isin(sorted({f[1] for f in folders})))
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = F.broadcast(keys) if few else keys
    same = (rows[AT_COLLECTION] == keys[AT_COLLECTION]) & (rows[AT_BUCKET] == keys[AT_BUCKET]) & (rows["doc"] == keys["wanted_doc"])
    return rows.join(keys, same, "left_semi")


def commit(spark: SparkSession, path: str, build: Callable[[Version], dict[str, Rows]], added: tuple[str, ...] = ()) -> Version:
    """Adds a segment of the tables that build(version) gives: on conflict they are built again on the newer version. The table
    `gone` (collection, doc) takes away all older rows of its keys, but not from tables in `added`."""
    for _ in range(TRIES):
        base = version(spark, path)
        tables = build(base)
        segment = uuid.uuid4().hex
        try:
            rows, schemas = put(path, segment, tables)
            new = Version(base.no + 1, (*base.segments, Segment(segment, base.no + 1, rows)), base.schemas | schemas, tuple(sorted({*base.added, *added})))
            publish(spark, path, new)
        except BaseException as error:
            delete(spark, *(f"{path}/{name}/{AT_SEGMENT}={segment}" for name in tables))
            if isinstance(error, Conflict):
                continue
            raise
        return new
    raise Conflict(f"{TRIES} other commits to {path} came first")


def compact(spark: SparkSession, path: str) -> Version:
    """The latest version's live rows as one segment, a version of its own. Changes that add up are summed."""
    base = version(spark, path)
    if len(base.segments) < 2:
        return base
    tables = {}
    for name in base.schemas:
        if name == GONE:
            continue
        rows = live(spark, path, name, base)
        tables[name] = summed(rows) if name in base.added else rows
    segment = uuid.uuid4().hex
    rows, _ = put(path, segment, tables)
    new = Version(base.no + 1, (Segment(segment, base.no + 1, rows),), base.schemas, base.added)
    try:
        publish(spark, path, new)
    except Conflict:
        delete(spark, *(f"{path}/{name}/{AT_SEGMENT}={segment}" for name in tables))
        return version(spark, path)  # the other commit stands; its writer or a later one merges
    return new


def summed(rows: DataFrame) -> DataFrame:
    """Changes that add up: the sums of the columns of numbers by the others, without those that are all zero."""
    sums = [f.name for f in rows.schema if f.dataType.typeName() in ("long", "integer") and f.name != "collection"]
    total = rows.groupBy(*(c for c in rows.columns if c not in sums)).agg(*(F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in sums))
    return total.filter(F.greatest(*(F.abs(c) for c in sums), F.lit(0)) > 0).select(*rows.columns)


def roll_back(spark: SparkSession, path: str, no: int) -> Version:
    """Makes what version `no` held the latest version again, as a version of its own."""
    old = version(spark, path, no)
    new = old._replace(no=versions(spark, path)[-1] + 1)
    publish(spark, path, new)
    return new


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the last versions, and the segments that none of these names, those of dead writers included. No commit
    may run meanwhile."""
    held = versions(spark, path)
    kept = [version(spark, path, n) for n in held[-keep:]]
    named = {s.id for v in kept for s in v.segments}
    gone = [manifest(path, n) for n in held[:-keep]]
    place, system = _file_system(spark, path)
    for table in system.listStatus(place) if held else []:
        if table.getPath().getName() != "_versions":
            gone += [s.getPath().toString() for s in system.listStatus(table.getPath()) if s.getPath().getName().removeprefix(f"{AT_SEGMENT}=") not in named]
    delete(spark, *gone)
