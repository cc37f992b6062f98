"""Rows kept in the folder that the cluster shares, so that later jobs read them and not their lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and reads them back without lineage.

    Without spark.checkpoint.dir a temporary folder does in local mode only: on a cluster executors
    would write to folders that the driver and other executors cannot read.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return df.checkpoint()
