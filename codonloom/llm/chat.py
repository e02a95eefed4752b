"""Chat formatting: event logs folded into final messages, then rendered and read back.

An event is (conv_id, message, seq, op, role, text). `open` starts a message and
names its role, `delta` appends text, `edit` replaces what the message holds,
`regenerate` empties it for deltas to follow. Only DataFrame functions are used.

Defined results: null texts and roles are empty; turns sort null first, then by
turn, role and text, so repeated rows stay separate turns; a null conv_id is a
conversation of its own; an empty table gives only conversation -1; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Turns whose places are summed at once.
CHUNK = 64
#: Every control string, ours or another template's, starts with one of these.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def turns_to_events(turns: DataFrame) -> DataFrame:
    """A log as a chat server would stream it: an open event, then the text in two deltas. Of three messages one is first drafted, then regenerated, and one is edited into its final text."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    first, rest, kind = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.char_length("text")), F.col("message") % 3
    event = lambda k, when, op, text: F.when(when, F.struct(F.lit(k).alias("k"), F.lit(op).alias("op"), text.alias("text")))
    events = F.array(
        event(0, F.lit(True), "open", F.lit("")), event(1, kind == 1, "delta", F.concat(rest, F.lit("…"), first)), event(2, kind == 1, "regenerate", F.lit(None).cast("string")),
        event(3, kind == 2, "delta", rest), event(4, kind == 2, "edit", first), event(5, kind != 2, "delta", first), event(6, F.lit(True), "delta", rest),
    )
    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("message", F.row_number().over(w).cast("long"))
        .withColumn("e", F.explode(F.filter(events, lambda e: e.isNotNull())))
        .select("conv_id", "message", (F.col("message") * 8 + F.col("e.k")).alias("seq"), F.col("e.op").alias("op"), "role", F.col("e.text").alias("text"))
    )


def fold(events: DataFrame) -> DataFrame:
    """conv_id, messages: array<struct<message, role, text>> in order of their first event.

    A message's text is what its last edit or regenerate left plus the deltas
    after it. Messages are folded first, so the conversation's group holds one
    row per message.
    """
    per_message = Window.partitionBy("conv_id", "message")
    last_reset = F.max(F.when(F.col("op").isin("edit", "regenerate"), F.col("seq"))).over(per_message)
    kept = F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset"))
    says = kept & F.col("op").isin("delta", "edit")
    messages = (
        events.withColumn("_reset", last_reset)
        .groupBy("conv_id", "message")
        .agg(
            F.min("seq").alias("seq"),
            F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))), F.lit("")).alias("role"),
            F.sort_array(F.collect_list(F.when(says, F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))).alias("parts"),
        )
        .withColumn("text", F.array_join(F.col("parts.text"), ""))
    )
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "message", "role", "text"))).alias("messages"))


def starts_of(lengths: Column) -> Column:
    """array<int>: the sums of the lengths before each place. Taken in chunks, so that no long array is copied once an element."""
    grown = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    chunk = lambda s, c: F.aggregate(F.slice(lengths, c * CHUNK + 1, CHUNK), F.struct(s["at"].alias("at"), F.array().cast("array<int>").alias("out")), grown)
    both = lambda s, r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / CHUNK).cast("int"))
    return F.flatten(F.aggregate(chunks, start, lambda s, c: F.get(F.transform(F.array(chunk(s, c)), lambda r: both(s, r)), F.lit(0)), lambda s: s["out"]))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: 0-based start and length, in code points, of each assistant text."""
    shape = lambda m: F.struct((m["role"] == "assistant").alias("loss"), F.concat(F.lit(TURN), escape(m["role"]), F.lit(TEXT)).alias("head"), escape(m["text"]).alias("text"))
    rows = conversations.select("conv_id", F.explode(F.array(F.transform("messages", shape))).alias("s"))
    rows = rows.select("conv_id", "s", F.explode(F.array(F.transform("s", lambda m: F.char_length(m["head"]) + F.char_length(m["text"]) + len(END)))).alias("n"))
    placed = F.zip_with("s", starts_of(F.col("n")), lambda m, at: F.when(m["loss"], F.struct((at + F.char_length(m["head"])).alias("start"), F.char_length(m["text"]).alias("length"))))
    formatted = F.array_join(F.transform("s", lambda m: F.concat(m["head"], m["text"], F.lit(END))), "")
    return rows.select("conv_id", formatted.alias("formatted"), F.filter(placed, lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns: array<struct<role, text>> and loss_text, both parsed from `formatted` alone (and its spans).

    The text is cut into turns once; a span must be one turn's text, else it is an error.
    """
    pieces = F.filter(F.split("formatted", END.replace("|", r"\|")), lambda p: p != "")
    inner = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.char_length(p))
    rows = rendered.select("conv_id", "formatted", "loss_spans", F.explode(F.array(pieces)).alias("p"))
    rows = rows.select("*", F.explode(F.array(F.transform("p", lambda p: F.char_length(p) + len(END)))).alias("n"))
    parts = F.zip_with(F.transform("p", lambda p: F.split(inner(p), TEXT.replace("|", r"\|"))), starts_of(F.col("n")), lambda x, at: F.struct(x[0].alias("role"), x[1].alias("text"), (at + len(TURN + TEXT) + F.char_length(x[0])).alias("start")))
    rows = rows.select("conv_id", "formatted", "loss_spans", F.explode(F.array(parts)).alias("parts"))
    turns = F.transform("parts", lambda p: F.struct(unescape(p["role"]).alias("role"), unescape(p["text"]).alias("text")))
    said = F.filter("parts", lambda p: p["role"] == "assistant")
    same = lambda p, s: (p["start"] == s["start"]) & (F.char_length(p["text"]) == s["length"])
    loss = F.zip_with(said, "loss_spans", lambda p, s: F.when(F.coalesce(same(p, s), F.lit(False)), unescape(p["text"])).otherwise(F.raise_error(F.lit("a span is no assistant text")).cast("string")))
    return rows.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "SELECT CAST(-1 AS BIGINT) conv_id, turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(render(fold(turns_to_events(turns))))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), esc AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS e_text,
         replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS e_role FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e_text) + length(e_role) + 23) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
