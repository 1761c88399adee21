"""Stored tables with replace, upsert and delete by key.

A table is a Parquet folder partitioned by a hash bucket of its key. A change rewrites only the
buckets its keys fall into, through Spark's dynamic partition overwrite: the task commit protocol
makes it restartable, and replaying the same change gives the same table. Within a bucket the rows
are spread over several writers, so one large file cannot pile up in one task. Every touched
bucket also receives a row of NULLs, which makes sure that a bucket left empty is still
overwritten; readers skip those rows. Chunks that lie by bucket already (``PlacedChunks``) are
written from where they lie, a few buckets at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusloom import sizing
from corpusloom.operators import chunking
from corpusloom.operators.ranking import first_wins
from corpusloom.session import remove_path, scratch_path, writing

#: Chunks placed by bucket are replaced in groups of buckets: of about so many stored bytes, or of a part of them all.
GROUP_BYTES = 32 << 20
GROUPS = 8
#: Buckets that a task writes to at a time where its rows lie by bucket.
OPEN_FILES = 8


def _schema(strings: list[str], longs: list[str]) -> T.StructType:
    fields = [T.StructField(n, T.StringType()) for n in strings] + [T.StructField(n, T.LongType()) for n in longs]
    return T.StructType(fields)


CHUNK = _schema(
    ["text", "filename", "file_type", "file_path", "chunk_id", "parent_chunk_id", "root_chunk_id"],
    ["page_number", "chunk_idx", "chunk_level"],
)
PAGE = _schema(["filename", "file_path", "file_type", "text"], ["page_number", "version"])
MESSAGE = _schema(["user_id", "session_id", "type", "content", "timestamp", "rag_trace"], ["turn"])


class StoredTable:
    """Rows of ``schema`` under ``path``, replaced by ``key`` (a file name, a session) as a unit."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], row_id: list[str], buckets: int = 64):
        self.spark, self.path, self.schema = spark, path, schema
        self.key, self.row_id, self.buckets = key, row_id, buckets
        self.spread = 16
        #: What a writer's rows have in common, so that rows which resemble each other are compressed together.
        self.together: list[Column] = [F.col(c) for c in row_id]

    def exists(self) -> bool:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def create(self) -> None:
        """Create the folder when it is missing."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], self._stored()), "append")

    def drop(self) -> None:
        """Remove the table and its files."""
        remove_path(self.spark, self.path)

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("bucket", T.LongType())])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets).cast("long"))

    def _raw(self) -> DataFrame:
        return self.spark.read.schema(self._stored()).parquet(self.path)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self._raw().filter(F.col(self.key[0]).isNotNull()).drop("bucket")

    def query(self, condition: Column | None = None, fields: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Filtered projection; with ``limit`` the first rows in row-id order, so that the cut is reproducible."""
        rows = self.read() if condition is None else self.read().filter(condition)
        rows = rows if limit is None else rows.orderBy(*self.row_id).limit(limit)
        return rows.select(*(fields or rows.columns))

    def by_ids(self, ids: list[str], column: str = "chunk_id", fields: list[str] | None = None) -> DataFrame:
        """Rows whose id is listed; blank ids are ignored."""
        wanted = [i for i in ids if i]
        rows = self.read().filter(F.col(column).isin(wanted))
        return rows.select(*(fields or rows.columns))

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """All rows of the keys, read from their buckets only."""
        rows = self._raw().filter(F.col("bucket").isin(self._touched(keys)) & F.col(self.key[0]).isNotNull()).drop("bucket")
        return sizing.lookup_join(rows, keys.select(*self.key).distinct(), self.key, "left_semi", self.row_id)

    def append(self, rows: DataFrame, rows_per_file: int = 0) -> None:
        self._write(self._placed(rows), "append", rows_per_file)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]).withColumn(
            "bucket", self.bucket()
        )

    def _write(self, rows: DataFrame, mode: str, rows_per_file: int = 0, placed: bool = False) -> None:
        """Rows that are ``placed`` lie by bucket already, few buckets in a task, and are not dealt anew."""
        salt = F.pmod(F.xxhash64(*self.together), F.lit(self.spread))
        dealt = rows if placed else rows.repartition("bucket", salt)
        writer = dealt.write.mode(mode).option("compression", "zstd").partitionBy("bucket")
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        with writing(rows.sparkSession, OPEN_FILES if placed else 0):
            writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def _touched(self, keys: DataFrame) -> list[int]:
        """Bucket numbers of the keys: at most ``buckets`` integers."""
        return [r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]

    def _rewrite(self, touched: list[int], rows: DataFrame, placed: bool = False) -> None:
        markers = self.spark.createDataFrame([(b,) for b in touched], "bucket bigint")
        markers = markers.coalesce(1) if placed else markers
        self._write(rows.unionByName(markers, allowMissingColumns=True).select(*self._stored().names), "overwrite", placed=placed)

    def _survivors(self, touched: list[int], gone: DataFrame, on: list[str]) -> DataFrame:
        old = self._raw().filter(F.col("bucket").isin(touched) & F.col(self.key[0]).isNotNull())
        return sizing.lookup_join(old, gone, on, "left_anti", self.row_id)

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows`` the whole content of every key they mention."""
        self.create()
        keys = rows.select(*self.key).distinct()
        touched = self._touched(keys)
        if touched:
            self._rewrite(touched, self._survivors(touched, keys, self.key).unionByName(self._placed(rows)))

    def shared_buckets(self, touched: list[int], keys: DataFrame) -> set[int]:
        """Those of the buckets that also hold rows of other keys."""
        return {r.bucket for r in self._survivors(touched, keys, self.key).select("bucket").distinct().collect()} if touched else set()

    def replace_placed(self, rows: DataFrame, touched: list[int], keys: DataFrame, shared: set[int]) -> None:
        """``replace`` by rows that lie by bucket, in these buckets; only the ``shared`` ones are read for rows of other keys."""
        new = self._placed(rows)
        both = sorted(shared.intersection(touched))
        self._rewrite(touched, self._survivors(both, keys, self.key).unionByName(new) if both else new, placed=True)

    def delete(self, keys: DataFrame) -> int:
        """Remove all rows of the keys; returns how many there were."""
        if not self.exists():
            return 0
        keys = keys.select(*self.key).distinct()
        touched = self._touched(keys)
        old = self._raw().filter(F.col("bucket").isin(touched))
        gone = sizing.lookup_join(old, keys, self.key, "left_semi", self.row_id).count() if touched else 0
        if gone:
            self._rewrite(touched, self._survivors(touched, keys, self.key))
        return gone

    def upsert(self, rows: DataFrame, arrival: str) -> int:
        """Insert or overwrite single rows by row id, the latest ``arrival`` winning; blank ids are skipped."""
        self.create()
        filled = rows.filter(F.trim(F.coalesce(F.col(self.row_id[0]), F.lit(""))) != "")
        latest = first_wins(filled, self.row_id, [F.desc(arrival)])
        touched = self._touched(latest)
        if touched:
            ids = latest.select(*self.row_id)
            self._rewrite(touched, self._survivors(touched, ids, self.row_id).unionByName(self._placed(latest)))
        return filled.count()


class PlacedChunks:
    """Pages with their chunks, cut once and stored by bucket of their file, as numbered chunk rows of a few buckets at a time.

    What is stored is scratch data: ``release`` removes buckets that are done with, ``drop`` all.
    """

    def __init__(self, pages: DataFrame, chunks: Column, bucket: Column):
        self.spark = pages.sparkSession
        self.path = scratch_path(self.spark, "made")
        # The chunks are named more than once: in a projection of their own they are cut once.
        cut = pages.select("filename", F.col("page_number").cast("long").alias("page_number"), "file_path", "file_type", bucket.alias("bucket"), chunks.alias("_chunks"))
        some = lambda test: F.size(F.filter("_chunks", test)).cast("long")
        counted = cut.withColumns({"n": F.size("_chunks").cast("long"), "rows": some(lambda c: c.isNotNull()), "leaves": some(lambda c: c["level"] == 3)})
        with writing(self.spark, OPEN_FILES):
            counted.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/pages")
        self.kind = T.StructType([*(f for f in counted.schema.fields if f.name != "bucket"), T.StructField("bucket", T.LongType())])
        per_page = self._pages().filter("n > 0").groupBy("filename", "page_number").agg(F.sum("n").alias("n"))
        offsets = chunking.packed_offsets(per_page).withColumn("bucket", bucket)
        files = self._pages().filter("page_number is not null and rows > 0").groupBy("filename", "bucket").agg(F.sum("leaves").alias("leaves"))
        with writing(self.spark):
            offsets.write.parquet(f"{self.path}/offsets")
            files.write.parquet(f"{self.path}/files")
        self._offsets, self.files = self.spark.read.parquet(f"{self.path}/offsets"), self.spark.read.parquet(f"{self.path}/files")

    def _pages(self) -> DataFrame:
        return self.spark.read.schema(self.kind).parquet(f"{self.path}/pages")

    def rows(self, buckets: list[int]) -> DataFrame:
        here = F.col("bucket").isin(buckets)
        pages = self._pages().filter(here).drop("n", "rows", "leaves", "bucket")
        return chunking.number_pages(pages, offsets=self._offsets.filter(here).drop("bucket"))

    def groups(self) -> Iterator[list[int]]:
        """Buckets of files with chunks, a few at a time, so that only part of the chunks lies here and in the tables as well."""
        size = {r.bucket: self._bytes(r.bucket) for r in self.files.select("bucket").distinct().collect()}
        most = max(GROUP_BYTES, sum(size.values()) // GROUPS)
        group: list[int] = []
        for bucket in sorted(size, key=lambda b: (-size[b], b)):
            if group and sum(map(size.get, group)) + size[bucket] > most:
                yield group
                group = []
            group.append(bucket)
        if group:
            yield group

    def _folder(self, bucket: int) -> str:
        return f"{self.path}/pages/bucket={bucket}"

    def _bytes(self, bucket: int) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(bucket))
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()

    def release(self, buckets: list[int]) -> None:
        for bucket in buckets:
            remove_path(self.spark, self._folder(bucket))

    def drop(self) -> None:
        remove_path(self.spark, self.path)


class Collection:
    """A searchable document collection: leaf chunks and their parents, replaced per file."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.leaves = StoredTable(spark, f"{path}/leaves", CHUNK, ["filename"], ["chunk_id"], buckets)
        self.parents = StoredTable(spark, f"{path}/parents", CHUNK, ["filename"], ["chunk_id"], buckets)
        for table in (self.leaves, self.parents):
            table.together = [F.col("page_number"), F.floor(F.col("chunk_idx") / 1000)]
        #: Every page that ever arrived, with its version; only appended to.
        self.pages = StoredTable(spark, f"{path}/pages", PAGE, ["filename"], ["filename", "version", "page_number"], buckets)

    def create(self) -> None:
        self.pages.create()
        self.leaves.create()
        self.parents.create()

    def replace_files(self, chunks: DataFrame | PlacedChunks) -> None:
        """Replace whole files by their freshly made chunks: levels 1 and 2 are parents, 3 leaves.

        The chunks must have been produced (and should be checkpointed) before this is called, so a
        document that fails to parse leaves its stored version alone. Files without any leaf are
        refused, before any file is replaced. Placed chunks are used up.
        """
        placed = isinstance(chunks, PlacedChunks)
        leaves = chunks.files if placed else chunks.groupBy("filename").agg(F.count_if(F.col("chunk_level") == 3).alias("leaves"))
        if not leaves.filter("leaves = 0").isEmpty():
            raise ValueError("a document gave no searchable leaf chunk")
        if placed:
            self._replace_placed(chunks)
            return
        self.parents.replace(chunks.filter(F.col("chunk_level").isin(1, 2)))
        self.leaves.replace(chunks.filter(F.col("chunk_level") == 3))

    def _replace_placed(self, chunks: PlacedChunks) -> None:
        groups = list(chunks.groups())
        tables = (self.parents, F.col("chunk_level").isin(1, 2)), (self.leaves, F.col("chunk_level") == 3)
        keys = chunks.files.select("filename")
        shared = {}
        for table, _ in tables:
            table.create()
            shared[table] = table.shared_buckets([b for group in groups for b in group], keys)
        for group in groups:
            rows = chunks.rows(group)
            for table, kind in tables:
                table.replace_placed(rows.filter(kind), group, keys, shared[table])
            chunks.release(group)

    def add_pages(self, pages: DataFrame) -> DataFrame:
        """Keep arrived pages; returns the pages of the newest version of each file they belong to.

        The newest version is taken from all pages kept, so it depends neither on how pages are dealt over
        calls nor on their order, and adding the same pages again changes nothing. Pages without file name or
        version can't be placed; they are kept aside, see ``rejected_pages``.
        """
        named = pages.withColumn("filename", F.coalesce("filename", F.lit("")))
        whole = (F.col("filename") != "") & F.col("version").isNotNull()
        self.pages.create()
        self.pages.append(named.withColumn("version", F.when(whole, F.col("version"))))
        arrived = scratch_path(self.pages.spark, "arrived")
        with writing(named.sparkSession):
            named.filter(whole).select("filename").distinct().write.parquet(arrived)
        kept = self.pages.of_keys(self.pages.spark.read.parquet(arrived)).filter("version is not null")
        newest = kept.groupBy("filename").agg(F.max("version").alias("version"))
        latest = sizing.lookup_join(kept, newest, ["filename", "version"], "left_semi", ["page_number"])
        return _distinct(latest).drop("version")

    def rejected_pages(self) -> DataFrame:
        """Pages that arrived without file name or version."""
        return self.pages.read().filter("version is null")

    def delete_files(self, filenames: DataFrame) -> int:
        """Delete files; returns the number of leaf chunks removed."""
        self.pages.delete(filenames)
        self.parents.delete(filenames)
        return self.leaves.delete(filenames)

    def documents(self) -> DataFrame:
        return list_documents(self.leaves.read())


def _distinct(rows: DataFrame) -> DataFrame:
    """``dropDuplicates`` that shuffles hashes, and whole rows only where a hash comes twice."""
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    twice = hashed.groupBy("_hash").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash")
    if twice.isEmpty():
        return rows
    once, again = (sizing.lookup_join(hashed, twice, ["_hash"], how, rows.columns).select(*rows.columns) for how in ("left_anti", "left_semi"))
    return once.unionByName(again.dropDuplicates())


def list_documents(leaves: DataFrame) -> DataFrame:
    """(filename, file_type, chunk_count): the type is that of the file's first chunk."""
    return leaves.groupBy("filename").agg(
        F.min_by("file_type", F.struct("page_number", "chunk_id")).alias("file_type"), F.count("*").alias("chunk_count")
    )


def session_store(spark: SparkSession, path: str, buckets: int = 64) -> StoredTable:
    """Chat history table: ``replace`` saves whole sessions, ``delete`` drops them."""
    return StoredTable(spark, path, MESSAGE, ["user_id", "session_id"], ["user_id", "session_id", "turn"], buckets)
