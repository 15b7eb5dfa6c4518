"""Requests for batch inference and their responses, as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecmill.operators.ranking import running_total

# The request format's version and its usual token limit, and the least number of
# requests that a batch may hold.
FORMAT_VERSION = "bedrock-2023-05-31"
MAX_TOKENS = 1000
BATCH_MINIMUM = 100

MESSAGES = "array<struct<role:string,content:string>>"
REQUEST = f"anthropic_version string, max_tokens int, system string, messages {MESSAGES}"


def message(role: str | Column, content: str | Column) -> Column:
    """A chat message."""
    role = F.col(role) if isinstance(role, str) else role
    content = F.col(content) if isinstance(content, str) else content
    return F.struct(role.alias("role"), content.alias("content"))


def conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
    system_role: str = "system",
    max_turns: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """``(conv_id, part, system, messages)``: messages in turn order, system turns apart.

    A conversation is one part, unless a limit is given. ``max_turns`` puts that many turns, by their
    rank and whatever their numbers, to a part. ``max_bytes`` starts a part with the first turn that
    begins at or after each multiple of it in the conversation's UTF-8 text, so a part is shorter than
    the limit and its last turn; parts are numbered without gaps. System turns are joined by line breaks in
    turn order; every part carries those of the whole conversation. Turns without content are no
    message (``without_content`` lists them); no other turn is lost, and a conversation of nothing
    but system turns is one part without messages.

    With a limit no group is larger than a part, however long a conversation is.
    """
    if max_turns is not None and max_bytes is not None:
        raise ValueError("max_turns or max_bytes, not both")
    for limit in (max_turns, max_bytes):
        if limit is not None and limit < 1:
            raise ValueError(f"a limit must be at least 1, not {limit}")
    held = turns.select(conv_id, turn, role, content).filter(F.col(content).isNotNull())
    system = F.coalesce(F.col(role) == system_role, F.lit(False))
    said = F.when(~system, F.struct(turn, F.col(role).alias("role"), F.col(content).alias("content")))
    told = F.when(system, F.struct(turn, F.col(content).alias("content")))
    lines = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(F.array_sort(c), lambda m: m["content"]), "\n"))
    limit = max_turns if max_turns is not None else max_bytes
    if limit is None:
        parts = held.withColumn("part", F.lit(0).cast("long"))
    else:
        size = F.lit(1) if max_turns is not None else F.octet_length(content)
        order = [F.col(turn), F.col(role), F.col(content)]
        parts = running_total(held, conv_id, order, size, "_before").withColumn(
            "part", F.call_function("div", F.col("_before"), F.lit(limit))
        )
    grouped = parts.groupBy(conv_id, "part").agg(
        lines(F.collect_list(told)).alias("system"), F.array_sort(F.collect_list(said)).alias("_said")
    )
    if limit is not None:
        whole = held.where(system).groupBy(conv_id).agg(lines(F.collect_list(told)).alias("system"))
        # Parts that only system turns fill are left out, and the numbers close up.
        several = Window.partitionBy(conv_id)
        number = F.row_number().over(several.orderBy((F.size("_said") == 0), "part")) - 1
        filled = grouped.drop("system").withColumn("_filled", F.max(F.size("_said") > 0).over(several))
        numbered = filled.withColumn("part", number.cast("long")).filter((F.size("_said") > 0) | (~F.col("_filled") & (F.col("part") == 0)))
        grouped = numbered.drop("_filled").join(whole, conv_id, "left")
    messages = F.transform("_said", lambda m: message(m["role"], m["content"]))
    return grouped.select(conv_id, "part", "system", messages.alias("messages"))


def without_content(turns: DataFrame, content: str = "text") -> DataFrame:
    """The turns that no request can hold because they have no content."""
    return turns.filter(F.col(content).isNull())


def record_id(conv_id: str = "conv_id", part: str = "part") -> Column:
    """The name of a request: that of the conversation, and of the part after the first."""
    name = F.col(conv_id).cast("string")
    return F.when(F.col(part) == 0, name).otherwise(F.concat_ws("-", name, F.col(part).cast("string")))


def request_json(
    messages: str | Column,
    system: str | Column | None = None,
    max_tokens: int = MAX_TOKENS,
    version: str = FORMAT_VERSION,
) -> Column:
    """A request as JSON text. ``system`` is a column; wrap a constant in ``lit``."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    system = F.col(system) if isinstance(system, str) else system
    fields = [F.lit(version).alias("anthropic_version"), F.lit(max_tokens).alias("max_tokens")]
    if system is not None:
        fields.append(system.alias("system"))
    return F.to_json(F.struct(*fields, messages.alias("messages")))


def parse_responses(
    df: DataFrame, column: str, schema: T.StructType | str
) -> tuple[DataFrame, DataFrame]:
    """Split into rows that parse, with ``response`` in place of the JSON text, and the others,
    as they came, with ``error``. Nothing is dropped and no bad row fails the job."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    corrupt = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    parsed = df.withColumn("_parsed", F.from_json(column, wide, options))

    def valid(response: Column) -> Column:
        return response.isNotNull() & response[corrupt].isNull()

    # The parsed value is tested as the element of an array, so that each side parses it once; a
    # plain filter on it would parse again for the output.
    parsed_once = F.array("_parsed")
    good = parsed.select(
        *[c for c in df.columns if c != column],
        F.explode(F.filter(parsed_once, valid)).alias("_parsed"),
    )
    fields = F.struct(*[F.col(f"_parsed.`{n}`").alias(n) for n in schema.names])
    failed = parsed.filter(F.exists(parsed_once, lambda r: ~valid(r))).select(
        *df.columns, F.lit("not the expected JSON").alias("error")
    )
    return good.withColumn("response", fields).drop("_parsed"), failed


def check_responses(df: DataFrame, column: str, schema: T.StructType | str, required: Sequence[str] = ()) -> DataFrame:
    """All rows of ``df``, with ``response`` in place of the JSON text, ``valid`` and ``reason``.

    One pass over the rows: a variant of the text tells whether the paths that are ``required``
    (``$.hits.hits[0]``) are there, and the text is read by ``schema``. The reason is ``no response`` (null), ``not JSON``,
    ``other type at top`` (no object), ``missing <path>`` (the first of ``required`` that is absent or null) or
    ``other shape`` (values of other types than ``schema`` has); then ``response`` is null and
    ``body`` keeps the text, so nothing is lost.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    kept = [c for c in df.columns if c != column]
    corrupt = "_corrupt_record"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    typed = df.select(*kept, F.col(column).alias("body"), F.try_parse_json(column).alias("_v"), F.from_json(column, wide, options).alias("_typed"))
    reasons = [
        F.when(F.col("body").isNull(), "no response"),
        F.when(F.col("_v").isNull(), "not JSON"),
        F.when(~F.schema_of_variant("_v").startswith("OBJECT"), "other type at top"),
        *[F.when(F.try_variant_get("_v", path, "variant").isNull() | F.is_variant_null(F.try_variant_get("_v", path, "variant")), f"missing {path}") for path in required],
        F.when(F.col("_typed").isNull() | F.col(f"_typed.{corrupt}").isNotNull(), "other shape"),
    ]
    checked = typed.withColumn("reason", F.coalesce(*reasons))
    valid = F.col("reason").isNull()
    return checked.select(
        *kept,
        F.when(valid, F.struct(*[F.col(f"_typed.`{n}`").alias(n) for n in schema.names])).alias("response"),
        valid.alias("valid"),
        "reason",
        F.when(~valid, F.col("body")).alias("body"),
    )
