"""Request quota audit (Q1, Q2) over event time, re-aimed from a per-process
rate limiter: tumbling windows per client.

Counting is a partial hash aggregate. Finding the over-limit requests needs
each request's position inside its (client, window) group; instead of one
window sort per group (a hot client would land in one task), the rows are
salted, each salted sub-group keeps only its first ``limit`` keys (any of the
group's first ``limit`` must be among them), the small candidate set yields
the group's ``limit``-th key, and rows after it are the rejected ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The original limits (per client address).
DEFAULT_LIMITS = (("minute", 60, 30), ("hour", 3600, 50), ("day", 86400, 200))


def _windowed(requests: DataFrame, periods) -> DataFrame:
    """One row per (request, period) with its tumbling window's start (windows begin at the epoch) and limit, from one scan.
    A period is (name, seconds, limit)."""
    micros = F.unix_micros(F.col("requested_at").cast("timestamp"))
    each = F.array(*(F.struct(F.lit(name).alias("period"),
                              F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000))).alias("window_start"),
                              F.lit(limit).alias("max_requests")) for name, seconds, limit in periods))
    return (requests.select("request_id", "client_ip", "requested_at", F.explode(each).alias("w"))
            .select("request_id", "client_ip", "requested_at", "w.*")
            .withColumn("window_start", F.col("window_start").cast(requests.schema["requested_at"].dataType)))


def usage(requests: DataFrame, periods=DEFAULT_LIMITS) -> DataFrame:
    """Q1: requests per client and window, with the limit and whether it is exceeded."""
    w = _windowed(requests, periods)
    return (w.groupBy("client_ip", "period", "window_start", "max_requests").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("over_limit", F.col("n") > F.col("max_requests")))


def rejected(requests: DataFrame, periods=DEFAULT_LIMITS) -> DataFrame:
    """Q2: requests beyond the limit in their window (order: requested_at, request_id).

    The last request allowed is found by a rank that nobody needs beyond the largest limit, so each task keeps
    that many rows of a window before the shuffle, however hot a client is. Its place in the order is then joined back.
    """
    w = _windowed(requests, periods).withColumn("_key", F.struct("requested_at", "request_id"))
    group = ["client_ip", "period", "window_start"]
    order = Window.partitionBy(*group).orderBy("_key")
    largest = max(limit for _, _, limit in periods)
    cut = (w.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= largest)
            .where(F.col("_r") == F.col("max_requests")).select(*group, F.col("_key").alias("_cut")))
    out = w.join(cut, group).where(F.col("_key") > F.col("_cut"))
    return out.select("request_id", "client_ip", "period", "window_start")
