"""Saved predictions as a versioned table.

A batch of changes (create / update / delete, ordered by
``(changed_at, change_id)``) is applied to a snapshot with joins, grouped
aggregates and no per-row driver work:

* ownership never changes and users are static, so authorisation of every
  change is decided by order-free joins;
* whether a favourite still exists at a change depends only on its first
  authorised delete (a ``min`` per id) and, for created rows, on its creation
  point;
* the surviving value of a row is its last applied update (``max_by`` per id).

All per-id aggregates use partial aggregation, so an id touched by a third of
all changes is reduced map-side; joins back to the change table are
equi-joins that AQE can broadcast or skew-split. The judged changes are written once
to the shared folder, and every result is derived from them.

Numbers of a change may be text; booleans that a change lacks take the service's
defaults (clean title, no accident). A created row's id is its change's id above the snapshot's largest, so ids
never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerlens.session import materialize

# Failure messages.
MSG_FAV_NOT_FOUND = "Favorite prediction not found"
MSG_USER_NOT_FOUND = "User not found"
MSG_NO_PERMISSION = "You don't have permission to access this resource"
MSG_BRAND = "Brand is required"
MSG_MODEL = "Model is required"
MSG_PRICE = "Predicted price is required"
# A number the body must hold; the original fails there with the platform's own message.
MSG_NUMBER = (("mileage", "Mileage must be a number"), ("engine", "Engine must be a number"),
              ("model_year", "Model year must be a number"))

FIELDS = ("brand", "model", "model_year", "mileage", "engine", "fuel_type", "transmission", "clean_title",
          "has_accident", "predicted_price", "prediction_data")
SNAPSHOT_COLUMNS = ("id", "user_id") + FIELDS + ("created_at",)


def _blank(c: Column) -> Column:
    """Java ``String.isBlank`` (null counts as blank here)."""
    return c.isNull() | c.rlike(r"^[\s\x1c-\x1f]*$")


def error_code(message: Column, op: Column) -> Column:
    """HTTP status for a failure message; creates always fail with 400."""
    low = F.lower(message)
    code = (F.when(low.contains("expired"), 400).when(low.contains("invalid"), 400)
             .when(low.contains("not verified"), 401).when(low.contains("not found"), 404).otherwise(400))
    return F.when(message.isNull(), F.lit(None)).when(op == "create", F.lit(400)).otherwise(code)


def users_scan(users: DataFrame) -> DataFrame:
    """Users without secrets."""
    return users.select("id", "email", "enabled")


def duplicate_emails(signups: DataFrame) -> DataFrame:
    """Emails that would violate the unique constraint."""
    return signups.groupBy("email").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def favorites_by_user(users: DataFrame, favorites: DataFrame) -> DataFrame:
    """Every user's favourites, keyed by the user's email."""
    u = users.select(F.col("id").alias("_uid"), "email")
    return favorites.join(u, favorites["user_id"] == u["_uid"], "inner").drop("_uid")


def resolve_users(changes: DataFrame, users: DataFrame) -> DataFrame:
    """Attach ``actor_id`` (null: no such user) to every change; a field the table lacks is null."""
    lacking = [F.lit(None).cast("boolean" if c in ("clean_title", "has_accident") else "string").alias(c)
               for c in FIELDS if c not in changes.columns]
    changes = changes.select("*", *lacking)
    u = users.select(F.col("email").alias("_email"), F.col("id").alias("actor_id"))
    return changes.join(u, changes["user_email"] == u["_email"], "left").drop("_email")


def _order(c_at: str = "changed_at", c_id: str = "change_id") -> Column:
    return F.struct(F.col(c_at).alias("at"), F.col(c_id).alias("cid"))


def _number(name: str) -> Column:
    """The field as a double; what is not a finite number is null (JSON has no other)."""
    x = F.col(name).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _whole(name: str) -> Column:
    """The field as an int: cut to a whole number, and to the nearest bound."""
    x = _number(name)
    return F.when(x >= 2.0**31 - 1, F.lit(2**31 - 1)).when(x <= -2.0**31, F.lit(-2**31)).otherwise(x.cast("int"))


def payload_fields() -> list[Column]:
    """The eleven fields a change carries, as a row stores them."""
    return [
        F.col("brand"), F.col("model"),
        _whole("model_year").alias("model_year"),
        _number("mileage").alias("mileage"), _number("engine").alias("engine"),
        F.col("fuel_type"), F.col("transmission"),
        F.coalesce(F.col("clean_title"), F.lit(True)).alias("clean_title"),
        F.coalesce(F.col("has_accident"), F.lit(False)).alias("has_accident"),
        _number("predicted_price").alias("predicted_price"),
        F.col("prediction_data"),
    ]


def creates(resolved: DataFrame, snapshot: DataFrame, above: int | None = None) -> DataFrame:
    """Create changes with ``message`` (null = accepted) and the new rows' values; new ids lie over ``above``, or over the snapshot's.

    The numbers are read before the user is looked up, then brand and model are checked; a new row has no prediction data.
    """
    c = resolved.where(F.col("op") == "create")
    c = c.select("change_id", "op", "changed_at", "actor_id", *payload_fields()).withColumn("prediction_data", F.lit(None).cast("string"))
    msg = F.coalesce(
        *(F.when(F.col(name).isNull(), F.lit(text)) for name, text in MSG_NUMBER),
        F.when(F.col("predicted_price").isNull(), F.lit(MSG_PRICE)),
        F.when(F.col("actor_id").isNull(), F.lit(MSG_USER_NOT_FOUND)),
        F.when(_blank(F.col("brand")), F.lit(MSG_BRAND)),
        F.when(_blank(F.col("model")), F.lit(MSG_MODEL)))
    largest = snapshot.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("m")).scalar() if above is None else F.lit(above)
    return c.select(
        "change_id", "op", "changed_at", (largest + F.col("change_id")).alias("id"), F.col("actor_id").alias("user_id"),
        *FIELDS, F.col("changed_at").alias("created_at"), msg.alias("message"),
    )


def _targets(snapshot: DataFrame, accepted_creates: DataFrame) -> DataFrame:
    """Every row that can be addressed: (id, owner, birth order; null = before the batch)."""
    new = accepted_creates.select("id", F.col("user_id").alias("owner"), _order().alias("born"))
    snap = snapshot.select("id", F.col("user_id").alias("owner"),
                           F.lit(None).cast(new.schema["born"].dataType).alias("born"))
    return snap.unionByName(new)


def access(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """J2 + J7 for update/delete changes: ``message`` null when applied.

    Order of checks as in the service: the row must exist at that point, then
    the user must exist, then own the row.
    """
    ch = resolved.where(F.col("op").isin("update", "delete")).withColumn("_ord", _order())
    t = targets.select(F.col("id").alias("_tid"), "owner", "born")
    x = ch.join(t, ch["favorite_id"] == t["_tid"], "left")
    exists_before = F.col("_tid").isNotNull() & (F.col("born").isNull() | (F.col("_ord") > F.col("born")))
    authorised = exists_before & F.col("actor_id").isNotNull() & (F.col("actor_id") == F.col("owner"))
    x = x.withColumn("_exists", exists_before).withColumn("_auth", authorised)
    first_delete = (x.where((F.col("op") == "delete") & F.col("_auth"))
                     .groupBy(F.col("favorite_id").alias("_fid")).agg(F.min("_ord").alias("_deleted_at")))
    x = x.join(first_delete, x["favorite_id"] == first_delete["_fid"], "left")
    alive = F.col("_exists") & (F.col("_deleted_at").isNull() | (F.col("_ord") <= F.col("_deleted_at")))
    msg = (F.when(~alive, F.lit(MSG_FAV_NOT_FOUND))
            .when(F.col("actor_id").isNull(), F.lit(MSG_USER_NOT_FOUND))
            .when(F.col("actor_id") != F.col("owner"), F.lit(MSG_NO_PERMISSION)))
    return x.withColumn("message", msg).drop("_tid", "_fid", "_exists", "_auth", "_deleted_at", "born")


def exists_by_id_and_user(resolved: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Changes whose (favorite_id, user) pair exists in the snapshot (semi-join)."""
    ch = resolved.where(F.col("favorite_id").isNotNull() & F.col("actor_id").isNotNull())
    s = snapshot.select(F.col("id").alias("_sid"), F.col("user_id").alias("_suid"))
    return ch.join(s, (ch["favorite_id"] == s["_sid"]) & (ch["actor_id"] == s["_suid"]), "left_semi")


def judge(snapshot: DataFrame, changes: DataFrame, users: DataFrame, above: int | None = None) -> DataFrame:
    """Every change once, with the row it is about (``id``, ``user_id`` of a new row), its fields, ``message`` (null =
    applied) and ``code``; written to the shared folder."""
    resolved = materialize(resolve_users(changes, users), "resolved_changes")
    made = creates(resolved, snapshot, above)
    acc = access(resolved, _targets(snapshot, made.where(F.col("message").isNull())))
    addressed = acc.select("change_id", "op", "changed_at", F.col("favorite_id").alias("id"), F.lit(None).cast("long").alias("user_id"),
                           *payload_fields(), F.col("changed_at").alias("created_at"), "message")
    both = addressed.unionByName(made.withColumn("user_id", F.col("user_id").cast("long")))
    return materialize(both.withColumn("code", error_code(F.col("message"), F.col("op"))), "judged_changes")


def apply_changes(snapshot: DataFrame, changes: DataFrame, users: DataFrame, above: int | None = None) -> dict[str, DataFrame]:
    """Returns ``snapshot``, ``created``, ``updated``, ``deleted``, ``outcomes`` (one row a change), ``access``, and ``written``
    (the snapshot's rows that the changes made or updated). ``above`` keeps new ids over all that were ever given."""
    judged = judge(snapshot, changes, users, above)
    applied = judged.where(F.col("message").isNull())
    accepted = applied.where(F.col("op") == "create").select(*SNAPSHOT_COLUMNS)
    values = F.struct(*FIELDS, F.col("change_id").alias("last_change_id"))
    effect = (applied.where(F.col("op") != "create").groupBy(F.col("id").alias("_id"))
              .agg(F.max(F.col("op") == "delete").alias("_gone"),
                   F.max_by(values, F.when(F.col("op") == "update", _order())).alias("_u")))
    base = (snapshot.select(*SNAPSHOT_COLUMNS, F.lit(False).alias("_new"))
            .unionByName(accepted.withColumn("_new", F.lit(True))))
    merged = base.join(effect, base["id"] == effect["_id"], "left").where(~F.coalesce(F.col("_gone"), F.lit(False)))
    cols = [F.col("id"), F.col("user_id")] + [
        F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) for c in FIELDS
    ] + [F.col("created_at")]
    final = merged.select(*cols, F.col("_u.last_change_id").alias("last_change_id"), "_new")
    outcomes = judged.select("change_id", "op", F.col("id").alias("favorite_id"), "message", "code")
    return {
        "snapshot": final.drop("last_change_id", "_new"),
        "written": final.where(F.col("_new") | F.col("last_change_id").isNotNull()).drop("last_change_id", "_new"),
        "created": accepted,
        "updated": final.where(F.col("last_change_id").isNotNull()).drop("_new"),
        "deleted": applied.where(F.col("op") == "delete").select("id", "change_id"),
        "outcomes": outcomes,
        "access": outcomes.where(F.col("op") != "create"),
    }


def _js_locale(x: Column, max_frac: int) -> Column:
    """en-US ``toLocaleString`` with at most ``max_frac`` fraction digits."""
    r = F.round(x, max_frac)
    txt = F.format_number(r, max_frac)
    return F.regexp_replace(txt, r"\.?0+$", "") if max_frac > 0 else txt


def report(favorites: DataFrame) -> DataFrame:
    """P10: the favourites table as displayed."""
    dash = lambda c: F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit("-")).otherwise(F.col(c))
    mileage = F.when(F.col("mileage").isNull() | (F.col("mileage") == 0) | F.isnan("mileage"), F.lit("-")) \
        .otherwise(F.concat(_js_locale(F.col("mileage"), 3), F.lit(" mi")))
    year = F.when(F.col("model_year").isNull() | (F.col("model_year") == 0), F.lit("-")) \
        .otherwise(F.col("model_year").cast("string"))
    price = F.concat(F.lit("$"), F.when(F.col("predicted_price").isNull(), F.lit("0"))
                     .otherwise(_js_locale(F.col("predicted_price"), 0)))
    return favorites.select(
        "id", dash("brand").alias("brand"), dash("model").alias("model"), year.alias("model_year"),
        mileage.alias("mileage"), dash("fuel_type").alias("fuel_type"), dash("transmission").alias("transmission"),
        F.when(F.col("clean_title"), "Yes").otherwise("No").alias("clean_title"), price.alias("price"),
    )
