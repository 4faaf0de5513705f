"""Audit and chat records as nested JSON, and the check of the schema they go to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions import text as t

#: Properties an audit table must have, with their kinds, and the kinds its flag may have. Fixed values.
REQUIRED = {"name": "title", "date": "date", "ip address": "rich_text"}
FLAG, FLAG_KINDS = "wrong pwd", ("checkbox", "select", "status", "rich_text")


def rich_text(c: Column) -> Column:
    return F.transform(t.text_chunks(c), lambda x: F.struct(F.struct(x.alias("content")).alias("text")))


def schema_problems(properties: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """The required properties that properties (name, kind) lacks or has of another kind: property, wanted, found; for each of per,
    if many tables are looked at."""
    own = properties.select(*per, t.property_name(F.col("name")).alias("property"), F.col("kind").alias("found"))
    required = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(w).alias("wanted")) for p, w in (*REQUIRED.items(), (FLAG, "|".join(FLAG_KINDS)))])
    tables = properties.select(*per).distinct() if per else properties.sparkSession.range(1).select()
    wanted = tables.select(*per, F.inline(required))
    return wanted.join(own, [*per, "property"], "left").filter(F.col("found").isNull() | ~F.array_contains(F.split("wanted", r"\|"), F.col("found")))


def login_records(events: DataFrame, flag_kind: str = "rich_text", names: dict[str, str] | None = None) -> DataFrame:
    """payload: one JSON record for each login attempt (name, stamp, ip, wrong BOOLEAN); names maps the required properties to
    the names the table gives them."""
    n = {p: p for p in (*REQUIRED, FLAG)} | (names or {})
    flag = F.from_json(t.flag_value(F.col("wrong"), F.lit(flag_kind)), "checkbox boolean, select struct<name:string>, status struct<name:string>, rich_text array<struct<text:struct<content:string>>>")
    record = F.struct(
        F.struct(rich_text(F.col("name")).alias("title")).alias(n["name"]),
        F.struct(F.struct(F.col("stamp").alias("start")).alias("date")).alias(n["date"]),
        F.struct(rich_text(F.col("ip")).alias("rich_text")).alias(n["ip address"]),
        flag.alias(n[FLAG]),
    )
    return events.select("*", F.to_json(F.struct(record.alias("properties"))).alias("payload"))


def delivered(records: DataFrame, post: Callable[[str], int], payloads: tuple[str, ...] = ("payload",), least: int = 300) -> DataFrame:
    """records with `status`, what post answered, and `accepted`, the column of payloads that was taken (null: none). The payloads
    of a row are posted in turn until one is answered below least, so a table that refuses token counts as numbers gets them as
    text. Each row is posted once by a task; a repeated task posts again."""
    schema = T.StructType([*records.schema, T.StructField("status", T.LongType()), T.StructField("accepted", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = []
            for row in batch[list(payloads)].itertuples(index=False):
                status, accepted = None, None
                for name, payload in zip(payloads, row, strict=True):
                    status = int(post(payload))
                    if status < least:
                        accepted = name
                        break
                told.append((status, accepted))
            yield batch.assign(status=[s for s, _ in told], accepted=[a for _, a in told])

    return records.mapInPandas(run, schema)


def checked(sent: DataFrame) -> DataFrame:
    """sent, which ends with an error where a record was not accepted."""
    lost = F.raise_error(F.concat(F.lit("a record was refused with status "), F.col("status"))).cast("string")
    return sent.withColumn("accepted", F.when(F.col("accepted").isNull(), lost).otherwise(F.col("accepted")))


def chat_records(chats: DataFrame, tokens_as_text: bool = False) -> DataFrame:
    """payload: one JSON record for each chat (question, answer, ip, app_name, stamp, token_input, token_output), the token counts
    as numbers or, for tables without number properties, as text."""
    def one(c: str) -> Column:
        return F.array(F.struct(F.struct(F.col(c).alias("content")).alias("text")))

    def count(c: str) -> Column:
        text = rich_text(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return F.struct(text.alias("rich_text")) if tokens_as_text else F.struct(F.col(c).alias("number"))

    record = F.struct(
        F.struct(F.array(F.struct(F.struct(F.lit("chat log").alias("content")).alias("text"))).alias("title")).alias("Title"),
        F.struct(one("app_name").alias("rich_text")).alias("App name"),
        F.struct(rich_text(F.col("question")).alias("rich_text")).alias("questions"),
        F.struct(rich_text(F.col("answer")).alias("rich_text")).alias("answer"),
        F.struct(one("ip").alias("rich_text")).alias("ip address"),
        F.struct(F.struct(F.col("stamp").alias("start")).alias("date")).alias("datetime"),
        count("token_input").alias("token_input"),
        count("token_output").alias("token_output"),
    )
    return chats.select("*", F.to_json(F.struct(record.alias("properties")), {"ignoreNullFields": "false"}).alias("payload"))
