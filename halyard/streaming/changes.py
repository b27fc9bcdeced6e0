"""Change detection over a stream of observations, with the same rules as over a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, seq long, content string, changed boolean, first_seen boolean"
STATE = "content string"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(batches)).sort_values("seq")
    before = [last, *rows["content"].tolist()[:-1]]
    now = rows["content"].tolist()
    state.update((now[-1],))
    yield pd.DataFrame(
        {"key": key[0], "seq": rows["seq"], "content": now, "changed": [b is not None and b != c for b, c in zip(before, now, strict=True)], "first_seen": [b is None for b in before]}
    )


def changes_stream(observations: DataFrame) -> DataFrame:
    """observations (key, seq, content) of a stream with what changed since the key's last one.

    The state is one hash per key. A key's rows must arrive in order of seq from batch to batch. To
    discard all state, as after a change of parser, begin a new checkpoint folder.
    """
    return observations.select("key", "seq", "content").groupBy("key").applyInPandasWithState(_follow, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def publish(changes: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append changed rows to a JSON log; by default take what there is and stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.filter("changed").write.mode("overwrite").json(f"{path}/batch={batch_id}")  # a repeated batch replaces itself

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
