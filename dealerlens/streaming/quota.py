"""Q3: per-client request counts over event-time tumbling windows.

A watermark bounds the state: windows older than the watermark are emitted
once (append mode) and dropped; requests arriving later than that are not
counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(requests: DataFrame, length: str = "1 hour", max_requests: int = 50,
                    delay: str = "10 minutes") -> DataFrame:
    # watermarks need TIMESTAMP; NTZ input is read in the session time zone
    requests = requests.withColumn("requested_at", F.col("requested_at").cast("timestamp"))
    return (requests.withWatermark("requested_at", delay)
            .groupBy(F.window("requested_at", length).alias("w"), "client_ip")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("client_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "n", (F.col("n") > max_requests).alias("over_limit")))
