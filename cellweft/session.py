"""Session helpers shared by tests, the bench and the tools."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and measurements; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cellweft")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where none is named, tables written on the way go beside the warehouse's tables, which every executor
    must reach as well; the setting is then made, so that one session uses one folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/cellweft-work"
        if folder.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder, unless the cluster has done so."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input with fewer splits than there are cores before a step that is heavy per row.

    A small file is one split, which would leave all but one core idle.  Large inputs have splits enough
    and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def work_folder(spark: SparkSession) -> str:
    """A new folder for written tables, in the shared folder."""
    return f"{shared_folder(spark)}/cellweft-{uuid.uuid4().hex}"


def kept(df: DataFrame, part: str) -> DataFrame:
    """The frame, written to the shared folder and read again: what stands before it is evaluated once, however often it is used."""
    path = f"{work_folder(df.sparkSession)}/{part}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The JVM leaves methods of more bytes to its interpreter.
COMPILED_BYTES = 8000


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """What is evaluated meanwhile runs in methods that the JVM compiles.

    A stage is one method otherwise, which with long expressions is interpreted for every row; beyond this limit Spark
    evaluates the stage's projections one by one, in methods that it splits.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Plan nodes that cost no more than reading the columns that are asked for.
PLAIN = {"Project", "Filter", "Union", "SubqueryAlias", "LocalRelation", "LogicalRelation", "DataSourceV2Relation", "DataSourceV2ScanRelation", "LogicalRDD", "Range"}


def is_plain(df: DataFrame) -> bool:
    """Whether a frame only reads, projects and filters, so that reading it again costs just the columns that are used."""
    plans = [df._jdf.queryExecution().optimizedPlan()]
    while plans:
        plan = plans.pop()
        # the name may be followed by what is read
        if plan.nodeName().split(" ")[0] not in PLAIN:
            return False
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return True


def evaluated_once(df: DataFrame, part: str = "input") -> DataFrame:
    """The frame to use several times: itself if it is plain, else written and read again."""
    return df if is_plain(df) else kept(df, part)
