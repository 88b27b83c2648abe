"""Registered queries for saved predictions and quotas."""

from __future__ import annotations

from dealerlens.operators import favorites as fav
from dealerlens.operators import quota
from dealerlens.sources.fixtures import fixture

# Fixture-sized quotas (the original 30/min, 50/h, 200/day are never reached
# by the fixture's request rate); the library defaults stay the original ones.
FIXTURE_LIMITS = (("hour", 3600, 2), ("day", 86400, 15))


def _tables(spark, sf_dir):
    return fixture(spark, sf_dir, "favorites"), fixture(spark, sf_dir, "changes"), fixture(spark, sf_dir, "users")


def _applied(spark, sf_dir):
    snap, changes, users = _tables(spark, sf_dir)
    return fav.apply_changes(snap, changes, users)


def q_users_scan(spark, sf_dir):
    return fav.users_scan(fixture(spark, sf_dir, "users"))


def q_duplicate_emails(spark, sf_dir):
    return fav.duplicate_emails(fixture(spark, sf_dir, "user_signups"))


def q_favorites_by_user(spark, sf_dir):
    snap, _, users = _tables(spark, sf_dir)
    return fav.favorites_by_user(users, snap).select("email", "id", "brand", "model", "predicted_price")


def q_favorite_access(spark, sf_dir):
    return _applied(spark, sf_dir)["access"]


def q_favorite_exists(spark, sf_dir):
    snap, changes, users = _tables(spark, sf_dir)
    return fav.exists_by_id_and_user(fav.resolve_users(changes, users), snap).select("change_id", "favorite_id")


def q_favorites_created(spark, sf_dir):
    return _applied(spark, sf_dir)["created"]


def q_favorites_updated(spark, sf_dir):
    return _applied(spark, sf_dir)["updated"]


def q_favorites_deleted(spark, sf_dir):
    return _applied(spark, sf_dir)["deleted"]


def q_favorites_snapshot(spark, sf_dir):
    return _applied(spark, sf_dir)["snapshot"]


def q_favorites_rejected(spark, sf_dir):
    out = _applied(spark, sf_dir)["outcomes"]
    return out.where(out["message"].isNotNull())


def q_favorites_report(spark, sf_dir):
    return fav.report(_applied(spark, sf_dir)["snapshot"])


def q_quota_usage(spark, sf_dir):
    return quota.usage(fixture(spark, sf_dir, "requests"), FIXTURE_LIMITS)


def q_quota_rejected(spark, sf_dir):
    return quota.rejected(fixture(spark, sf_dir, "requests"), FIXTURE_LIMITS)


QUERIES = {name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_") and callable(fn)}
