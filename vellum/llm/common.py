"""Shared helpers: scratch tables in the shared folder, models fitted on labelled samples, and Arrow row slices."""

from __future__ import annotations

import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 1 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local mode where none is configured (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='vellum-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't fill the memory of workers and of the buffers between them."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """Tables written once to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a kept table that no later result reads."""
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.startswith((self.root, self.root.replace("file://", "file:"), self.root.replace("file://", "file:///"))):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that never teaches a model; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fitted(docs: DataFrame, labels: DataFrame, label: str, fit: Callable[[list[str], list[int]], object], rows: int, max_chars: int, budget: int = 48_000_000):
    """What ``fit(texts, labels)`` makes of about ``rows`` labelled training documents; fitted in one executor task.

    The documents are chosen by a hash of the id and so the same in every run. Held-out ids, null labels, ids with two
    different labels and texts over ``max_chars`` characters are left out; of an id that repeats, the least text counts.
    The task takes documents in the order of their hash until they hold ``budget`` characters. A bounded sample for
    fitting only: neither it nor the texts reach the driver, only the model does.
    """
    by_id = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("other"))
    known = by_id.where("y = other").select("_id", "y")
    total = known.count()
    spread = F.pmod(F.xxhash64(F.col("_id"), F.lit(7)), F.lit(1 << 20))
    known = known.where(spread < int(min(1.0, rows / max(1, total)) * (1 << 20)) + 1).withColumn("at", spread)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= max_chars)
    # About ``rows`` short rows are broadcast; texts meet again by id only where an id repeats.
    sample = texts.join(F.broadcast(known), "_id").groupBy("_id", "at", "y").agg(F.min("text").alias("text")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((r["at"], r["_id"], r["y"], r["text"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        size, kept = 0, []
        for r in found:
            size += len(r[3])
            if size > budget:
                break
            kept.append(r)
        kept.sort(key=lambda r: r[1])
        model = fit([r[3] for r in kept], [int(r[2]) for r in kept])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(made.model) if made else fit([], [])


def slices(texts: list[str | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts as bytes, of about ``limit`` bytes each (one longer text is a run of its own)."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "replace")
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with the given columns added; columns of the same name, in whatever case, are replaced."""
    own = {n.lower() for n in columns}
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() not in own]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + list(columns.values()), names=[batch.schema.names[i] for i in kept] + list(columns))


def with_fields(df: DataFrame, fields: str) -> str:
    """The DDL of ``replaced`` for mapInArrow."""
    bounded_batches(df.sparkSession)
    names = {f.split()[0].lower() for f in fields.split(",")}
    own = ["`{}` {}".format(f.name.replace("`", "``"), f.dataType.simpleString()) for f in df.schema.fields if f.name.lower() not in names]
    return ", ".join(own + [fields])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """The public 64-bit finaliser of MurmurHash3, on arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
