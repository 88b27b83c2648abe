"""The batch scoring function applied to a stream of request bodies.

Scoring is stateless: per-row expressions, stream-static joins with the
fitted encoder tables and constant dimensions, and the model's row-wise
transform. The canonicaliser runs row by row here (no action inside a
streaming plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from dealerlens.plans import scoring as plan
from dealerlens.plans.training import TrainedModel


def score_stream(requests: DataFrame, trained: TrainedModel, as_of_year: int = plan.AS_OF_YEAR) -> DataFrame:
    return plan.score(requests, trained, as_of_year)


def start(requests: DataFrame, trained: TrainedModel, sink_path: str, checkpoint: str,
          as_of_year: int = plan.AS_OF_YEAR, fmt: str = "parquet") -> StreamingQuery:
    """Append scored rows to ``sink_path``; exactly-once through the checkpoint."""
    return (score_stream(requests, trained, as_of_year).writeStream.outputMode("append")
            .format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint).start())
