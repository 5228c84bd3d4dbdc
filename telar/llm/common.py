"""Shared parts of the training-data operators: scratch tables, Arrow mapping, bounded id filters."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are handed to the Python functions in slices of about so many bytes.
SLICE_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with neutral column names, which no operator's new columns clash with, and the neutral name of each column."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str], **new: Column) -> DataFrame:
    """The columns of before under their own names; new: columns that replace theirs."""
    return df.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


class Scratch:
    """Tables written to the folder that driver and executors share (spark.checkpoint.dir).

    They cut lineage, survive lost executors, and are deleted when the driver ends or drop() is
    called. Where no folder is set (tests on one machine) a temporary one is taken.

    A file costs more than its bytes: where Hadoop has no native library, each one on a local disk starts several
    processes (chmod). write() takes `rows`, about the rows that a table is made from, and merges partitions
    until each has `each` of them; tables with more rows than that in a partition are written as they are.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="telar-")
        self.root = f"{base.rstrip('/')}/telar-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def write(self, df: DataFrame, name: str, rows: int | None = None, each: int = 1 << 15) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        (df if rows is None else df.coalesce(max(1, -(-rows // each)))).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame | None = None) -> None:
        """Delete the files of a table that write() returned, or all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            paths = [self.root] if df is None else {f.rsplit("/", 1)[0] for f in df.inputFiles()}
            for p in paths:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended already; the folder goes with it
            pass


def sliced(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into parts whose texts hold about `most` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(
    df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField],
    make: Callable[[], Callable[[list], list]],
) -> DataFrame:
    """Columns `keep`, and new columns computed from the text, without a shuffle.

    make() runs once per task and returns f(texts) -> list of value lists, one for each new field.
    A column of `keep` that bears the name of a new field is replaced.
    """
    names = {f.name for f in fields}
    keep = [c for c in dict.fromkeys(keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches):
        f, types = make(), None
        for batch in batches:
            if types is None:
                types = [to_arrow(x.dataType) for x in fields]
            for part in sliced(batch, len(keep)):
                out = f(part.column(len(keep)).to_pylist())
                cols = [part.column(i) for i in range(len(keep))]
                cols += [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.name for x in schema])

    name = "_".join(["text", *keep])  # a name that no column has
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias(name)).mapInArrow(run, schema)


def to_arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(to_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in t])
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}[t.simpleString()]


def field(name: str, ddl: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(ddl) if "<" in ddl else SIMPLE[ddl])


SIMPLE = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


class IdFilter:
    """A one-hash Bloom filter of keys in built-in bitmaps, of fixed size: `buckets` x 4 KB.

    It is made by a group-by with map-side partial bitmaps and joined as a broadcast of at most
    `buckets` rows, whatever the number of keys. It lets through every key it holds and some others,
    so an exact join must follow; rows it stops need not be shuffled for that join.
    """

    def __init__(self, keys: DataFrame, key: str, buckets: int = 256):
        if not 1 <= buckets <= 4096:
            raise ValueError("buckets: 1 to 4096, so that a broadcast stays within 16 MB")
        self.buckets = buckets
        h = self._slot(F.col(key))
        self.bits = (
            keys.select((h / 32768).cast("long").alias("__bucket"), (h % 32768).alias("__bit"))
            .groupBy("__bucket").agg(F.expr("bitmap_construct_agg(__bit)").alias("__bits"))
        )

    def _slot(self, c: Column) -> Column:
        return F.pmod(F.xxhash64(c, F.lit("IdFilter")), F.lit(self.buckets * 32768))

    def flag(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """df with a boolean column: false where the key is certainly none of the set."""
        h = self._slot(key)
        out = df.withColumn("__slot", h).withColumn("__bucket", (F.col("__slot") / 32768).cast("long"))
        out = out.join(F.broadcast(self.bits), "__bucket", "left")
        byte = F.conv(F.hex(F.substring("__bits", ((F.col("__slot") % 32768) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("getbit", byte, (F.col("__slot") % 8).cast("int"))
        return out.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop("__slot", "__bucket", "__bits")


def drop_ids(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key is not in ids: an anti-join that shuffles only rows the filter lets through."""
    flagged = IdFilter(ids, key).flag(docs, F.col(key), "__maybe")
    clear = flagged.filter(~F.col("__maybe")).drop("__maybe")
    rest = flagged.filter("__maybe").drop("__maybe").join(ids.select(key).distinct(), key, "left_anti")
    return clear.unionByName(rest.select(*clear.columns))
