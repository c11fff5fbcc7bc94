"""When to reload: changes that follow each other closely are one reload, after the last of them.

In event time this is a session window, over a stored log of changes as over a stream of them: a burst ends once nothing
changed for the gap, and its reload is due then. Both forms take one shuffle on the key, and a stream keeps a row for each open burst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(changes: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, first_change, last_change, n_changes, reload_at) of each burst of a key: changes at most the gap apart.

    Changes without a time belong to no burst; those without a key are one key's. Over a stream with a watermark a burst
    comes out once the watermark has passed its end.
    """
    due = F.session_window(at, gap)
    found = changes.groupBy(key, due.alias("burst")).agg(F.min(at).alias("first_change"), F.max(at).alias("last_change"), F.count("*").alias("n_changes"))
    return found.select(key, "first_change", "last_change", "n_changes", F.col("burst.end").alias("reload_at"))


def reloads(stream: DataFrame, key: str, at: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """The same over a stream: each burst once, after its end; changes come at most `late` after their time."""
    return bursts(stream.withWatermark(at, late), key, at, gap)
