"""All registered queries: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from dealerlens.plans import favorites_queries, listing_queries, model_queries, request_queries


def queries():
    out = {}
    for mod in (listing_queries, model_queries, request_queries, favorites_queries):
        out.update(mod.QUERIES)
    return out
