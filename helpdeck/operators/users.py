"""The users table after a log of creates, edits and deletes.

Each request is judged by the table as it stands then: a name may be taken or
free again, a user may be gone, the last admin stays. Which requests take effect therefore
depends on which earlier ones did. ``replay_users`` settles that in rounds: from the outcomes assumed so far it
computes, by scans over pieces of the log, what every request meets, and from that the outcomes anew, until none changes.
An outcome depends on earlier requests only, so every round is right at least one request further than the one
before (in practice by far more: a round settles all that depends on settled ones), and outcomes that
reproduce themselves are those of a replay one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helpdeck.functions.dates import TS_FMT, now_ts
from helpdeck.functions.labels import ROLES
from helpdeck.operators.pieces import cut, running
from helpdeck.session import scratch_path

REASONS = ("user_created", "user_updated", "user_deleted", "missing_fields", "invalid_role", "username_taken", "user_not_found",
           "cannot_delete_last_admin", "nothing_updated")
FIELDS = ("username", "name", "role", "phone", "email")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def _well_formed(kind: Column) -> Column:
    """The reason why a request fails whatever the table holds, or NULL."""
    whole = _filled("name") & _filled("username") & _filled("password") & _filled("role")
    return (F.when(kind == "create", F.when(~whole, F.lit("missing_fields")).when(~F.col("role").isin(*ROLES), F.lit("invalid_role")))
            .when(kind == "edit", F.when(F.col("name").isNull() | F.col("username").isNull() | F.col("role").isNull(), F.lit("missing_fields"))))


def _round(steps: DataFrame, users: DataFrame, highest: int, admins: int) -> DataFrame:
    """``steps`` with ``reason`` and ``done`` anew, judged by what the requests with ``done`` so far have left, and ``uid``, whom it concerns.

    A scan reads its rows twice (the rows themselves, and the sums of their pieces). Each one's result is written, so that the
    scans before it run once and not twice for each scan after them.
    """
    order, done, kind = ["seq"], F.col("done"), F.col("kind")
    d = running(steps, [], order, {"_made": ("sum", F.when(done & (kind == "create"), 1).otherwise(0))})
    d = d.withColumn("uid", F.when(kind == "create", F.lit(highest) + F.col("_made") + 1).otherwise(F.coalesce("user_id", F.lit(-1)))).drop("_made")
    d = _written(d, "user-ids")
    # the user as the latest request that took effect left it, else as the table has it (ids of the batch are new ones)
    left = F.when(done, F.struct((kind != "delete").alias("there"), "role", "username"))
    d = running(d, ["uid"], order, {"_left": ("last", left)})
    own = users.select(F.col("id").alias("_id"), F.struct(F.lit(True).alias("there"), "role", "username").alias("_own"))
    d = d.join(own, F.col("uid") == F.col("_id"), "left")
    d = d.withColumn("_now", F.when(kind != "create", F.coalesce("_left", "_own"))).drop("_left", "_own", "_id")
    d = _written(d, "user-states")
    there = F.coalesce(F.col("_now.there"), F.lit(False))
    # names: a create or edit asks for one, and takes it if it succeeds; an edit or delete that succeeds frees the old one.
    # Every request stays one row, under the name it asks for or frees; only an edit that frees another name adds a row, that is dropped again
    asks, old = kind.isin("create", "edit"), F.col("_now.username")
    asked = F.when(asks, F.col("username"))
    freed = F.when(done & there & ~(asks & F.col("username").eqNullSafe(old)), old)
    free = F.struct(F.lit(None).cast("bigint").alias("who"))
    own_row = F.struct(F.coalesce(asked, F.when(~asks, old), F.lit("")).alias("u"), F.lit(True).alias("own"),
                       F.when(asks, F.when(asked.isNotNull() & done, F.struct(F.col("uid").alias("who")))).when(freed.isNotNull(), free).alias("holder"))
    more = F.when(asks & freed.isNotNull(), F.struct(freed.alias("u"), F.lit(False).alias("own"), free.alias("holder")))
    d = d.select("*", F.explode(F.array_compact(F.array(own_row, more))).alias("_x")).withColumn("_u", F.col("_x.u"))
    d = running(d, ["_u"], order, {"_held": ("last", F.col("_x.holder"))}).filter("_x.own").drop("_x", "_u")
    names = users.select(F.col("username").alias("_name"), F.struct(F.col("id").alias("who")).alias("_first"))
    d = d.join(names, asked == F.col("_name"), "left")
    d = d.withColumn("_holder", F.when(asked.isNotNull(), F.coalesce("_held", "_first")["who"])).drop("_held", "_first", "_name")
    d = _written(d, "user-names")
    # admins
    was, becomes = there & (F.col("_now.role") == "admin"), asks & (F.col("role") == "admin")
    change = F.when(done, becomes.cast("int") - F.coalesce(was.cast("int"), F.lit(0))).otherwise(0)
    d = running(d, [], order, {"_admins": ("sum", change)})
    taken = F.col("_holder").isNotNull() & ((kind == "create") | (F.col("_holder") != F.col("uid")))
    known = F.coalesce(F.col("_now.role").isin(*ROLES), F.lit(False))
    reason = (F.when(kind == "create", F.coalesce("_bad", F.when(taken, F.lit("username_taken")), F.lit("user_created")))
              .when(kind == "edit", F.when(~(there & known), F.lit("nothing_updated")).when(F.col("_bad").isNotNull(), F.col("_bad"))
                    .when(taken, F.lit("username_taken")).otherwise(F.lit("user_updated")))
              .otherwise(F.when(~there, F.lit("user_not_found")).when(~known, F.lit("invalid_role"))
                         .when((F.col("_now.role") == "admin") & (F.lit(admins) + F.col("_admins") <= 1), F.lit("cannot_delete_last_admin"))
                         .otherwise(F.lit("user_deleted"))))
    return d.withColumn("reason", reason).withColumn("was_done", done).withColumn(
        "done", F.col("reason").isin("user_created", "user_updated", "user_deleted")).drop("_now", "_holder", "_admins")


def replay_users(users: DataFrame, log: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """The users table after the ``log``, and the verdicts: ``seq, kind, user_id, done, reason`` (``REASONS``).

    ``log``: ``seq`` (unique), ``kind`` ('create', 'edit', 'delete'; others are ignored), ``user_id`` (whom an edit or delete names; ids that the batch
    itself hands out count), ``username, password, name, role, phone, email``. As in the reference: a create needs its four fields
    and a known role; ids continue after the highest one, refused creates take none; an edit writes all five fields, any role
    too, but only to a user whose role is a known one, and refuses a name that another user holds and NULL where the table allows none; a delete is
    refused for a user of an unknown role and for the only admin. Names are compared exactly.
    """
    kind = F.col("kind")
    steps = log.filter(kind.isin("create", "edit", "delete")).select("seq", "kind", F.col("user_id").cast("bigint").alias("user_id"), "username", "role",
                                                                     _well_formed(kind).alias("_bad"))
    steps = cut(steps, ["seq"]).withColumn("done", F.col("_bad").isNull())
    base = users.select("id", "username", "role")
    stored = base.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m"), F.count_if(F.col("role") == "admin").alias("a")).first()
    cols = ["seq", "kind", "user_id", "username", "role", "_bad", "_p", "done"]
    while True:
        steps = _written(_round(steps, base, stored["m"], stored["a"]), "user-steps")
        if steps.filter(F.col("done") != F.col("was_done")).isEmpty():
            break
        steps = steps.select(cols)
    verdicts = steps.select("seq", "kind", F.when((kind != "create") | F.col("done"), F.col("uid")).alias("user_id"), "done", "reason")
    last = (steps.filter("done").select("seq", "uid", "kind").join(log.select("seq", *FIELDS), "seq")
            .groupBy("uid").agg(F.max_by(F.struct("kind", *FIELDS), "seq").alias("x"), F.count_if(kind == "create").alias("_new")))
    j = users.join(last, F.col("id") == F.col("uid"), "left").filter(F.col("x").isNull() | (F.col("x.kind") != "delete"))
    text = {"phone": F.coalesce("x.phone", F.lit("")), "email": F.coalesce("x.email", F.lit(""))}
    kept = j.select(*[F.when(F.col("x").isNotNull(), text.get(c, F.col(f"x.{c}"))).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c)
                      for c in users.columns])
    made = {"id": F.col("uid"), "active": F.lit(1), "created_at": F.date_format(now_ts(now), TS_FMT)}
    new = last.filter((F.col("_new") > 0) & (F.col("x.kind") != "delete")).select(*[
        made.get(f.name, text.get(f.name, F.col(f"x.{f.name}") if f.name in FIELDS else F.lit(None))).cast(f.dataType).alias(f.name)
        for f in users.schema.fields])
    return kept.unionByName(new), verdicts
