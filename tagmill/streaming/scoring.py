"""Tagging cases as they arrive.

Prediction, smoothing and quality are stateless per case, so the batch operators run on
each micro-batch unchanged. A batch writes its own folder, so a replay after a failure
overwrites what it had written and nothing is tagged twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import judge, predict_tags
from ..sources.tables import write_stage


def tag_stream(preds: DataFrame, tag_info: DataFrame, path: str, checkpoint: str,
               top_k: int | None = None) -> StreamingQuery:
    """Write predicted tags and confidences of a stream of prediction rows.

    ``preds`` is a streaming DataFrame of (case_id, cells); ``tag_info`` is static. Takes
    what is available, then stops.
    """
    def tag(batch: DataFrame, batch_id: int) -> None:
        write_stage(predict_tags(judge(batch, tag_info), top_k), f"{path}/batch={batch_id}")

    return (preds.writeStream.foreachBatch(tag).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
