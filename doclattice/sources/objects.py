"""Small objects in a folder of any file system that Spark reads, and tables made where they are missing."""

from __future__ import annotations

import time

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs as stores
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ObjectStore:
    """Named objects below a folder, by the driver. A call that fails is tried again after ``wait`` seconds, then twice as long, and so on."""

    def __init__(self, spark: SparkSession, root: str, tries: int = 3, wait: float = 1.0) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root, self.tries, self.wait = root.rstrip("/"), tries, wait

    def again(self, act):
        for k in range(self.tries):
            try:
                return act()
            except (Py4JJavaError, CapturedException):
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait * 2**k)

    def place(self, key: str):
        """The file system and path of a key, which may not lead out of the folder."""
        if not key or key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"not a key: {key}")
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.conf), path

    def save(self, key: str, data: bytes) -> str:
        fs, path = self.place(key)

        def act():
            out = fs.create(path, True)
            try:
                out.write(bytearray(data))
            finally:
                out.close()

        self.again(act)
        return self.url(key)

    def get(self, key: str) -> bytes:
        fs, path = self.place(key)

        def act():
            stream = fs.open(path)
            try:
                return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()

        return self.again(act)

    def exists(self, key: str) -> bool:
        fs, path = self.place(key)
        return self.again(lambda: fs.exists(path))

    def delete(self, key: str) -> bool:
        """Whether there was such an object."""
        fs, path = self.place(key)
        return self.again(lambda: fs.delete(path, False))

    def url(self, key: str) -> str:
        fs, path = self.place(key)
        return fs.makeQualified(path).toString()


def open_root(root: str):
    """A pyarrow file system and the path in it, for local and remote roots alike."""
    scheme, mark, rest = root.partition("://")
    if mark:  # pyarrow knows Hadoop's S3 schemes by their plain name
        return stores.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{rest}")
    return stores.FileSystem.from_uri(root if root.startswith(("file:", "/")) else f"file://{root}")


def tried(act, tries: int = 3, wait: float = 1.0):
    """act(), again after a failure of the store, as ObjectStore does."""
    for k in range(tries):
        try:
            return act()
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(wait * 2**k)


def checked_keys(rows: DataFrame) -> DataFrame:
    """rows whose key does not lead out of the folder; others are an error."""
    ok = F.col("key").isNotNull() & (F.col("key") != "") & ~F.startswith("key", F.lit("/")) & ~F.array_contains(F.split("key", "/"), "..")
    return rows.withColumn("key", F.when(ok, F.col("key")).otherwise(F.raise_error(F.concat(F.lit("not a key: "), F.coalesce("key", F.lit("null"))))))


def save_all(rows: DataFrame, root: str) -> DataFrame:
    """rows (key, data binary) written as objects by the tasks that hold them -> key, bytes. A repeated task writes the same objects again. To be acted on once, and kept."""

    def run(batches):
        store, path = open_root(root)
        for b in batches:
            for key, data in zip(b["key"].to_pylist(), b["data"].to_pylist()):
                place = f"{path.rstrip('/')}/{key}"

                def act(place=place, data=data):
                    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(place) as out:
                        out.write(data or b"")

                tried(act)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array([len(d or b"") for d in b["data"].to_pylist()], pa.int64())], names=["key", "bytes"])

    return checked_keys(rows.select("key", "data")).mapInArrow(run, "key string, bytes long")


def delete_all(keys: DataFrame, root: str) -> DataFrame:
    """key, deleted: whether there was such an object."""

    def run(batches):
        store, path = open_root(root)
        for b in batches:
            gone = []
            for key in b["key"].to_pylist():
                place = f"{path.rstrip('/')}/{key}"
                there = tried(lambda place=place: store.get_file_info(place)).type == stores.FileType.File
                if there:
                    tried(lambda place=place: store.delete_file(place))
                gone.append(there)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(gone, pa.bool_())], names=["key", "deleted"])

    return checked_keys(keys.select("key")).mapInArrow(run, "key string, deleted boolean")


def read_all(spark: SparkSession, root: str) -> DataFrame:
    """key, content of every object below a folder, read by Spark."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    end = root.rstrip("/").rsplit("/", 1)[-1] + "/"
    return found.select(F.substring_index("path", end, -1).alias("key"), "content")


def ensure_tables(spark: SparkSession, schemas: dict[str, str]) -> list[str]:
    """Creates the tables (name -> columns) that are missing; their names."""
    made = [name for name in schemas if not spark.catalog.tableExists(name)]
    for name in made:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schemas[name]}) USING parquet")
    return made
