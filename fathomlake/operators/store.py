"""Conversation store: each change is a new snapshot made by joins, unions and projections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import blank_as_null
from ..sources import staged
from .ranking import small, top_k


def email(c: Column) -> Column:
    return F.lower(F.trim(c))


def token_of(cookie: Column, header: Column) -> Column:
    """The cookie, or what follows Bearer in the header."""
    return F.coalesce(blank_as_null(cookie), blank_as_null(F.regexp_extract(header, r"^Bearer (.*)", 1)))


def users_of_tokens(sessions: DataFrame, users: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Sessions that have not expired, with their users. The filter is before the join."""
    return sessions.where(F.col("expires_at") > F.lit(as_of)).join(users, "user_id")


def register(users: DataFrame, new: DataFrame) -> DataFrame:
    """The users (user_id, email, password_hash, full_name, created_at) with the new accounts: an address that is taken,
    or comes twice, gives none but the first. Hashes are made by the caller."""
    tidy = new.withColumns({"email": email(F.col("email")), "full_name": F.coalesce(blank_as_null(F.trim("full_name")), F.lit("Công dân"))})
    first = tidy.groupBy("email").agg(F.min_by(F.struct(*[c for c in users.columns if c != "email"]), F.struct("created_at", "user_id")).alias("u")).select("email", "u.*")
    return users.unionByName(first.join(users.select("email"), "email", "left_anti").select(*users.columns))


def authenticate(users: DataFrame, tries: DataFrame) -> DataFrame:
    """The account of each try (email, password_hash) that is right; hashes are compared, not made."""
    right = tries.select(email(F.col("email")).alias("email"), "password_hash")
    return users.join(right, ["email", "password_hash"]).select("user_id", "email", "full_name", "created_at")


def open_sessions(sessions: DataFrame, new: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Sessions with the new ones (token, user_id, created_at), which last so many days."""
    return sessions.unionByName(new.select("token", "user_id", (F.col("created_at") + F.make_dt_interval(F.lit(s.session_days))).alias("expires_at"), "created_at"))


def close_sessions(sessions: DataFrame, tokens: DataFrame) -> DataFrame:
    return sessions.join(tokens.select("token"), "token", "left_anti")


def list_conversations(conversations: DataFrame, user_id: int | None) -> DataFrame:
    mine = F.col("user_id").isNull() if user_id is None else F.col("user_id") == user_id
    return conversations.where(mine).orderBy(F.col("updated_at").desc(), "id")


def owned(conversations: DataFrame, id: str, user_id: int | None) -> DataFrame:  # noqa: A002
    return conversations.where((F.col("id") == id) & F.col("user_id").eqNullSafe(F.lit(user_id)))


def owned_by(conversations: DataFrame, asked: DataFrame) -> DataFrame:
    """Of conversations that are asked for (id, user_id, null for a guest) those that are the user's own."""
    wanted = small(asked.select(F.col("id").alias("asked_id"), F.col("user_id").alias("asked_by")))
    return conversations.join(wanted, (F.col("id") == F.col("asked_id")) & F.col("user_id").eqNullSafe(F.col("asked_by")), "left_semi")


def messages_in_order(messages: DataFrame) -> DataFrame:
    """Sources decoded, an empty list where they are no JSON array."""
    return messages.withColumn("sources", F.coalesce(F.from_json("sources", "array<string>"), F.array().cast("array<string>"))).orderBy("conversation_id", "created_at", "id")


def save_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New snapshots: absent conversations are made as a guest's, and those that were written to are touched."""
    last = new.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("last"), F.min("created_at").alias("begun"))
    made = last.join(conversations, "id", "left_anti").select("id", F.lit(None).cast("long").alias("user_id"), F.lit("Cuộc trò chuyện mới").alias("title"), F.lit("").alias("summary"), F.col("begun").alias("created_at"), F.col("last").alias("updated_at"))
    touched = conversations.join(last.select("id", "last"), "id", "left").withColumn("updated_at", F.coalesce("last", "updated_at")).drop("last")
    return touched.unionByName(made), messages.unionByName(new, allowMissingColumns=True)


def rate(messages: DataFrame, id: str, rating: int) -> DataFrame:  # noqa: A002
    return messages.withColumn("rating", F.when(F.col("id") == id, F.lit(rating)).otherwise(F.col("rating")))


def rename(conversations: DataFrame, id: str, title: str) -> DataFrame:  # noqa: A002
    return conversations.withColumn("title", F.when(F.col("id") == id, F.lit(title)).otherwise(F.col("title")))


def survivors(parents: DataFrame, children: DataFrame, victims: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the victims' rows (key). Few victims, by a count, are broadcast, and no table is shuffled."""
    gone = small(victims)
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def purge(parents: DataFrame, children: DataFrame, key: str, updated: str, as_of: dt.datetime, days: int = SETTINGS.retention_days) -> tuple[DataFrame, DataFrame]:
    """Parents not touched for more than so many days go, with their children; none if days is not positive."""
    if not days or days <= 0:
        return parents, children
    old = F.coalesce(F.col(updated) < F.lit(as_of - dt.timedelta(days=days)), F.lit(False))
    # A parent's own row says whether it goes; only its children need a join.
    return parents.where(~old), children.join(small(parents.where(old).select(key)), key, "left_anti")


def cascade(tables: list[tuple[DataFrame, str | None, str | None]], victims: DataFrame) -> list[DataFrame]:
    """Survivors of a chain of tables (table, its key, its parent's key), parents first. A child goes with its parent. Few victims
    are broadcast, so a small purge shuffles none of the tables."""
    out, gone = [], victims
    for table, key, parent in tables:
        on = parent or key
        lost = small(gone.withColumnRenamed(gone.columns[0], on))
        out.append(table.join(lost, on, "left_anti"))
        gone = table.join(lost, on, "left_semi").select(key) if key else gone
    return out


def emptied(table: DataFrame) -> DataFrame:
    return table.limit(0)


def deleted(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n, how many rows a change took out. Both counts are sums over the tables' parts."""
    a, b = before.agg(F.count("*").alias("a")), after.agg(F.count("*").alias("b"))
    return a.crossJoin(F.broadcast(b)).select((F.col("a") - F.col("b")).alias("n"))


def reset(tables: dict[str, DataFrame], scope: str, user_id: int | None = None) -> dict[str, DataFrame]:
    """The tables messages, conversations, sessions and users after a reset: `mine` (conversations of a user, or of
    guests for None, with their messages), `all` conversations and messages, or `everything`."""
    if scope == "everything":
        return {name: emptied(t) for name, t in tables.items()}
    if scope == "all":
        return tables | {name: emptied(tables[name]) for name in ("messages", "conversations")}
    conversations, messages = tables["conversations"], tables["messages"]
    mine = conversations.where(F.col("user_id").eqNullSafe(F.lit(user_id).cast("long"))).select(F.col("id").alias("conversation_id"))
    return tables | {"conversations": conversations.join(mine, F.col("id") == F.col("conversation_id"), "left_anti"), "messages": messages.join(mine, "conversation_id", "left_anti")}


def context_pieces(messages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """conversation_id, n, chars, created_at, content, role, piece: of conversations that have grown too long all messages but
    the last few, as rows in order of (created_at, content, role).

    Sums come first. The last messages are a top k, of which each task keeps k rows of a conversation; what is before the
    first of them is a filter. No task sorts or holds a conversation.
    """
    place = F.struct("created_at", "content", "role")
    long = messages.groupBy("conversation_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars")).where((F.col("n") >= s.context_messages) & (F.col("chars") >= s.context_chars))
    known = small(staged(long, "long_conversations"))
    # Written, as both steps below read it, and a table too large for a broadcast is sorted to find it.
    mine = staged(messages.select("conversation_id", "created_at", "content", "role").join(known, "conversation_id"), "messages_of_long").withColumn("place", place)
    last = top_k(mine.select("conversation_id", "place"), "conversation_id", [F.desc("place")], s.recent_messages, "back")
    # The first of the last messages, and how many of these are just like it.
    first = last.groupBy("conversation_id").agg(F.min("place").alias("first"), F.collect_list("place").alias("places"))
    first = first.select("conversation_id", "first", F.size(F.filter("places", lambda p: p == F.col("first"))).alias("like"))
    met = mine.join(small(staged(first, "first_of_last"), width=F.octet_length("first.content")), "conversation_id").where("place <= first")
    before, same = met.where("place < first"), met.where("place = first")
    same = same.withColumn("nth", F.row_number().over(Window.partitionBy("conversation_id").orderBy("role"))).where("nth > like")
    columns = ["conversation_id", "n", "chars", "created_at", "content", "role"]
    return before.select(*columns).unionByName(same.select(*columns)).withColumn("piece", F.concat(F.upper("role"), F.lit(": "), F.col("content")))


def context_windows(messages: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """conversation_id, n, chars, dialogue: the pieces of each conversation as one text."""
    pieces = context_pieces(messages, s)
    said = F.struct("created_at", "content", "role", "piece")
    return pieces.groupBy("conversation_id", "n", "chars").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["piece"]), "\n").alias("dialogue"))


def queue_positions(jobs: DataFrame, service_seconds: int = 60) -> DataFrame:
    """job_id, position: jobs of a queue (queue, job_id, arrived) that arrived less than a service time before, and one.

    Jobs are counted by second first. Seconds are summed up in slices of the service time, each with the slice before it,
    so a queue that holds most jobs is many windows of at most twice as many rows as a service time has seconds."""
    jobs = jobs.select("queue", "job_id", F.col("arrived").cast("timestamp").cast("long").alias("at"))
    seconds = jobs.groupBy("queue", "at").agg(F.count("*").alias("c")).withColumn("own", F.floor(F.col("at") / service_seconds))
    sliced = seconds.withColumn("slice", F.explode(F.array("own", F.col("own") + 1)))
    w = Window.partitionBy("queue", "slice").orderBy("at").rangeBetween(-service_seconds + 1, 0)
    upto = sliced.withColumn("all", F.sum("c").over(w)).where("slice = own").select("queue", "at", "all", "c")
    # Jobs of the same second wait in the order of their ids.
    same = jobs.withColumn("n", F.row_number().over(Window.partitionBy("queue", "at").orderBy("job_id")))
    return same.join(upto, ["queue", "at"]).select("job_id", "queue", (F.col("all") - F.col("c") + F.col("n")).alias("position"))
