"""A delta feed, an extension: entries that arrive as a stream are classified against what came before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "path string, version bigint, status string, size bigint"
_STATE = "version bigint, sha string"


def _classify(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("version")
    version, sha = state.get if state.exists else (None, None)
    out = []
    for r in rows.itertuples():
        if version is not None and r.version <= version:
            continue
        status = "new" if sha is None else "identical" if sha == r.sha else "modified"
        out.append((key[0], r.version, status, r.size))
        version, sha = r.version, r.sha
    if version is not None:
        state.update((version, sha))
    yield pd.DataFrame(out, columns=["path", "version", "status", "size"])


def classify_stream(entries: DataFrame) -> DataFrame:
    """(path, version, status, size) of a stream of (path, version, content).

    Each path keeps the last version and its checksum as state, never its content. A version that isn't later
    than the last one is late and dropped.
    """
    hashed = entries.select("path", F.col("version").cast("bigint").alias("version"), F.sha2(F.col("content").cast("binary"), 256).alias("sha"), F.octet_length(F.col("content").cast("binary")).cast("bigint").alias("size"))
    return hashed.groupBy("path").applyInPandasWithState(_classify, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
