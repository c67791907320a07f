"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def build_session(app: str = "casegrain", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only in local mode, where there is one machine, a fresh folder is made where neither is set.
    """
    context = spark.sparkContext
    root = (spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
            or context.getCheckpointDir())
    if not root:
        root = getattr(context, "_casegrain_root", None)
        if root is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="casegrain-")
            context._casegrain_root = root
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    Cuts the lineage like a checkpoint, but computes the rows only once and keeps them columnar.
    """
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """The rows dealt to all tasks, by ``keys`` where given: a large file or row group is one task of its scan otherwise.

    For work that makes much of little input: what one task then has to do or to hold is its share of the rows.
    """
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A folder name under the shared root that no other run uses."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
