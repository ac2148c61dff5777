"""What the operators share: the cluster's shared folder, cut lineages, and column maps over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of an Arrow batch, about: one long text may exceed them.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or, where that is unset in local mode, a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("mosaiq.shared.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mosaiq-")
        spark.conf.set("mosaiq.shared.dir", base)
    return f"{base}/mosaiq-{sc.applicationId}"


_written: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; clean() removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def clean() -> None:
    """Remove all scratch tables. Frames that still read them can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be over
            return


atexit.register(clean)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def passing():
    """Gives a cut(); at the end all scratch files made meanwhile are deleted, but those of what it returned."""
    old, kept = {path for _, path in _written}, set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = cut(df, name)
        kept.add(out._scratch)
        return out

    yield keep
    for spark, path in [x for x in _written if x[1] not in old | kept]:
        _written.remove((spark, path))
        _delete(spark, path)


def release(*frames: DataFrame) -> None:
    """Delete the files of frames from cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            _written[:] = [x for x in _written if x[1] != path]
            _delete(df.sparkSession, path)


def node_filter(nodes: DataFrame, bits: int = 26) -> bytes:
    """A bitmap of 2**bits bits in which the low bits of each number of column ``node`` are set. Its size is fixed, whatever the number of nodes."""
    at = F.col("node").bitwiseAND((1 << bits) - 1) + 1  # bucket k of Spark's bitmap functions holds 32768 numbers from 32768 * (k - 1) + 1
    rows = nodes.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("b")).collect()
    out = bytearray((1 << bits) // 8)
    for r in rows:  # 2**bits / 32768 rows of 4 kB at most
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = r["b"].ljust(4096, b"\0")
    return bytes(out)


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, for all that this session plans from here on: batches of whole texts would take a task's memory by rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().removesuffix("b")
    if now.isdigit() and int(now) > BATCH_BYTES:  # with another suffix it was set on purpose
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(
    df: DataFrame, text: str, keep: Iterable[str], out: T.StructType, make: Callable[[], Callable[[pa.Array], dict[str, object]]]
) -> DataFrame:
    """Columns ``row`` (a struct of the columns to keep) and ``out`` (a struct of what the function gives for each batch of texts).

    ``make`` is called once in each task. Results are nested, so that no name can clash.
    """
    bounded(df.sparkSession)
    names = [f.name for f in out.fields]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if list(keep) else F.struct(F.lit(0).alias("_"))
    given = df.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("out", out, False)])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in out.fields}

    def run(batches):
        fn = make()
        for batch in batches:
            got = fn(batch.column("text"))
            arrays = [got[n] if isinstance(got[n], pa.Array) else pa.array(got[n], kinds[n]) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(arrays, names=names)], ["row", "out"])

    return given.mapInArrow(run, schema)
