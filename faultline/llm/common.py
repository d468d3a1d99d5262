"""Small helpers the corpus operators share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import scratch_root

#: ASCII white space separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it back: lineage ends here, and a lost executor costs a re-read.

    What the steps before shuffled is no longer needed then; collecting the driver's garbage lets Spark delete it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/faultline-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    gc.collect()
    for _ in range(2):  # the first finds what Python has let go of, the second what the driver then let go of
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)
    return out


def drop_kept(*frames: DataFrame) -> None:
    """Delete tables made by ``keep`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        files = df.inputFiles()
        if files and "/faultline-" in files[0]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of a few dozen bytes each that may be broadcast.
SMALL = 1 << 19


def join_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Join with a kept table; it is broadcast if a count shows that it is small, else both sides are shuffled."""
    return df.join(F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small, on)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder (null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def spread_seed(*parts: Column | str, seed: int = 0) -> Column:
    """A 64-bit hash that is the same in every run."""
    return F.xxhash64(F.lit(seed), *parts)
