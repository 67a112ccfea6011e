"""The stored index: Parquet tables in generations, of which a pointer names those that count.

A generation holds what one update brought: rows of new and changed files, and which files' older rows they
replace. It is written in full before the pointer is put in place of the old one, which is a rename; a crash before
that leaves the index as it was, and readers that began before go on reading what they began with.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..errors import CorvaneError

#: Bytes of contents per hash bucket of the posting tables, and how many buckets there are at least and most.
BUCKET, LEAST, MOST = 256 << 20, 16, 4096
#: Generations, and replaced files per stored one, from which an update rewrites the index as one.
GENERATIONS, REPLACED = 12, 0.3
#: Names of replaced files or chunks that are broadcast.
FEW = 200_000
#: The column by which the rows of a table are replaced; tables without one are read of the last generation only.
KEYS = {"files": "path", "seen": "path", "chunks": "file_path", "imports": "src", "postings": "chunk_id"}
GATHERED = ("trigrams",)  # of contents: what no file has any more finds nothing


#: Tables of a generation that are written at once.
WRITERS = 6


def bucketed(df: DataFrame, key: Column, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _at(self, *names: str) -> str:
        return "/".join([self.root.rstrip("/"), *names])

    def pointer(self) -> dict:
        """What the pointer says; nothing where there is none, or none that can be read."""
        fs, at = self._fs(self._at("CURRENT"))
        try:
            if not fs.exists(at):
                return {}
            stream = fs.open(at)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            found = json.loads(text)
            return found if found.get("version") == schema.VERSION else {}
        except Exception:
            return {}

    def current(self) -> bool:
        """Whether there are tables of this version."""
        return bool(self.pointer())

    def _point(self, said: dict) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, new = self._fs(self._at(f"CURRENT-{uuid.uuid4().hex}"))
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()
        _, old = self._fs(self._at("CURRENT"))
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(old), overwrite)

    def write(self, *, whole: bool, size: int = 0, **tables: DataFrame) -> None:
        """A new generation: ``whole`` takes the place of all others; else ``removed`` (``path``) and ``removed_chunks``
        (``chunk_id``) name what is replaced. What the pointer before the last one named is deleted."""
        said = self.pointer()
        buckets = said["buckets"] if said and not whole else max(LEAST, min(MOST, size // BUCKET))
        name = f"g-{uuid.uuid4().hex}"
        schemas = {**said.get("schemas", {}), **{table: df.schema.json() for table, df in tables.items()}}

        def put(table: str, df: DataFrame) -> None:
            if table in ("postings", "trigrams"):
                # rebalanced: the bucket of a term that a third of all rows have is written by several tasks
                key = F.col("term" if table == "postings" else "trigram")
                df = bucketed(df, key, buckets).hint("rebalance", "bucket").sortWithinPartitions(key)
                df.write.partitionBy("bucket").parquet(self._at(name, table))
            else:
                df.write.parquet(self._at(name, table))

        # small tables are mostly waiting for their job to start
        with ThreadPoolExecutor(WRITERS) as pool:
            list(pool.map(lambda t: put(*t), tables.items()))
        schemas.update({t: bucketed(tables[t], F.lit(""), buckets).schema.json() for t in ("postings", "trigrams") if t in tables})
        held = [name] if whole else [*said["generations"], name]
        try:
            self._point({"version": schema.VERSION, "buckets": buckets, "generations": held, "schemas": schemas, "before": said.get("generations", [])})
        except Exception as e:
            raise CorvaneError("INDEX_BUILD_FAILED", "the new tables can't take the place of the old ones", path=self.root) from e
        for gone in {*said.get("before", [])} - {*held} - {*said.get("generations", [])}:
            fs, at = self._fs(self._at(gone))
            fs.delete(at, True)

    def _table(self, generation: str, name: str) -> DataFrame:
        schema_ = T.StructType.fromJson(json.loads(self.pointer()["schemas"][name]))
        return self.spark.read.schema(schema_).parquet(self._at(generation, name))

    def _dead(self, name: str, generations: list[str]) -> DataFrame | None:
        """Keys and the last generation that replaced their rows."""
        table = "removed_chunks" if name == "postings" else "removed"
        column = "chunk_id" if name == "postings" else "path"
        found = None
        for n, g in enumerate(generations[1:], 1):
            rows = self._table(g, table).select(F.col(column).alias(KEYS[name]), F.lit(n).alias("_dead"))
            found = rows if found is None else found.unionByName(rows)
        return None if found is None else found.groupBy(KEYS[name]).agg(F.max("_dead").alias("_dead"))

    def read(self, name: str, where: Column | None = None) -> DataFrame:
        """A table as it stands; ``where`` is applied in the scans."""
        said = self.pointer()
        if not said:
            raise CorvaneError("NO_INDEX", "nothing has been indexed here", "run index first", path=self.root)
        generations = said["generations"]
        if name not in KEYS and name not in GATHERED:
            generations = generations[-1:]
        every = None
        for n, g in enumerate(generations):
            rows = self._table(g, name)
            rows = (rows.filter(where) if where is not None else rows).withColumn("_generation", F.lit(n))
            every = rows if every is None else every.unionByName(rows)
        dead = self._dead(name, generations) if name in KEYS else None
        if dead is not None:
            dead = F.broadcast(dead) if dead.limit(FEW + 1).count() <= FEW else dead
            every = every.join(dead, KEYS[name], "left").filter(F.col("_dead").isNull() | (F.col("_generation") >= F.col("_dead"))).drop("_dead")
        every = every.drop("_generation")
        return every.distinct() if name in GATHERED and len(generations) > 1 else every

    def of(self, name: str, keys: list[str]) -> DataFrame:
        """The posting rows of ``keys``: only their buckets are read."""
        column, buckets = "term" if name == "postings" else "trigram", self.pointer().get("buckets", LEAST)
        met = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(k)), F.lit(buckets)).cast("int") for k in keys)))).distinct().collect()]
        return self.read(name, F.col("bucket").isin(*met) & F.col(column).isin(*keys)).drop("bucket")

    def crowded(self, replaced: int, files: int) -> bool:
        """Whether an update that replaces so many files had better write the index anew."""
        said = self.pointer()
        return len(said.get("generations", [])) >= GENERATIONS or replaced > REPLACED * max(1, files)

    def purge(self) -> None:
        fs, at = self._fs(self.root)
        fs.delete(at, True)
