"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: (conv_id, seq, kind, message_id, role, text). They are grouped by conversation
and message and folded in the order of seq: ``message`` starts a message with its text, ``delta`` appends to it,
``edit`` replaces the text, and ``regenerate`` empties the message for what follows and takes back every later
message that had begun by then. Final messages are rendered one row each, with the span of characters that counts
for the loss, and :func:`assemble` joins the rows of a conversation.

Template: ``[INST]`` text ``[/INST]`` for a user, ``<s>`` text ``</s>`` for an assistant, ``<<SYS>>`` text
``<</SYS>>`` for a system prompt, ``[ROLE:`` name ``]`` text ``[/ROLE]`` for any other role. A control string inside a
text gets a backslash after its first letter, one more where it had some, so that unescaping is exact.

Everything is DataFrame expressions. Events are dealt by conversation once; grouping, sorting, the running maximum and
the digests find their rows together and shuffle nothing again. A conversation's events stream through one task, sorted
and spilled where they are many; one message's events are one row, and the digest of the query, a hash of the whole
conversation by contract, is made of runs of 256 turns.

Edge cases: null text and role are empty; a null conv_id is a conversation of its own; events that share conv_id and
message_id are one message; ties of seq are folded in the order of kind and text (message, delta, edit, regenerate);
null seq comes first; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table

#: The template's marks.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE:", "[/ROLE]")
_TAILS = r"(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE:|/ROLE\])"
#: Turns that are joined to one row before a conversation's rows are.
RUN = 256
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, r"$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message_id, seq (of its first event), role, text.

    A message that is taken back and gets no later event is gone; one that gets some consists of those.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce(F.col("kind"), F.lit("message")))
    e = events.select("conv_id", "message_id", "seq", rank.cast("int").alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("seq"),
        F.max(F.when(F.col("rank") == 4, F.col("seq"))).alias("regenerated"),
        F.sort_array(F.collect_list(F.struct("seq", "rank", "text", "role"))).alias("log"),
    )
    m = _with_earlier_regeneration(grouped)
    live = F.filter("log", lambda x: F.coalesce(x["seq"] > F.col("taken_back"), F.lit(True)))
    # From the last event on that sets the text; what a message_id had before is history.
    last_set = F.aggregate(
        F.transform("live", lambda x, i: F.when(x["rank"] != 2, i)), F.lit(0), lambda a, x: F.greatest(a, F.coalesce(x, F.lit(0)))
    )
    m = m.withColumn("live", live).filter(F.size("live") > 0).withColumn("log", F.slice("live", last_set + 1, F.size("live")))
    role = F.coalesce(F.get(F.filter("live", lambda x: x["role"] != ""), F.lit(0))["role"], F.lit(""))
    text = F.array_join(F.transform("log", lambda x: F.when(x["rank"] == 4, F.lit("")).otherwise(x["text"])), "")
    return m.select("conv_id", "message_id", "seq", role.alias("role"), text.alias("text"))


def _with_earlier_regeneration(messages: DataFrame) -> DataFrame:
    """Adds taken_back: the last regeneration of a message that stands earlier in the conversation, as a running maximum."""
    before = W.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), F.col("message_id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    return messages.withColumn("taken_back", F.max("regenerated").over(before))


def render(messages: DataFrame) -> DataFrame:
    """Adds rendered, and loss_start and loss_end: the characters (from 0) of it that count for the loss."""
    role = F.col("role")
    opens, closes = F.concat(F.lit(OTHER[0]), F.url_encode(role), F.lit("]")), F.lit(OTHER[1])
    for name, (a, b) in MARKS.items():
        opens, closes = F.when(role == name, F.lit(a)).otherwise(opens), F.when(role == name, F.lit(b)).otherwise(closes)
    m = messages.withColumn("body", escape(F.col("text"))).withColumn("opens", opens)
    own = role == "assistant"
    start = F.when(own, F.length("opens")).otherwise(F.lit(0))
    return m.select("conv_id", "message_id", "seq", F.concat("opens", "body", closes).alias("rendered"), start.alias("loss_start"), (start + F.when(own, F.length("body")).otherwise(F.lit(0))).alias("loss_end"))


def parse(rendered: Column) -> Column:
    """A struct (role, text) read back from a rendered message."""
    body, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    inner = F.regexp_extract(rendered, r"(?s)^\[ROLE:([^\]]*)\](.*)\[/ROLE\]$", 2)
    body, role = inner, F.url_decode(F.regexp_extract(rendered, r"(?s)^\[ROLE:([^\]]*)\]", 1))
    for name, (a, b) in MARKS.items():
        here = rendered.startswith(F.lit(a))
        cut = F.substring(rendered, F.lit(len(a) + 1), F.length(rendered) - (len(a) + len(b)))
        body, role = F.when(here, cut).otherwise(body), F.when(here, F.lit(name)).otherwise(role)
    return F.struct(role.alias("role"), unescape(body).alias("text"))


def assemble(rendered: DataFrame) -> DataFrame:
    """One row a conversation: formatted text and loss spans in it. For conversations that fit into a row."""
    order = F.sort_array(F.collect_list(F.struct("seq", "message_id", "rendered", "loss_start", "loss_end")))
    lengths = F.transform("parts", lambda p: F.length(p["rendered"]))
    d = rendered.groupBy("conv_id").agg(order.alias("parts")).withColumn("lengths", lengths)
    before = F.aggregate("lengths", F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    spans = F.filter(F.zip_with("parts", F.slice(before, 1, F.size("parts")), lambda p, at: F.struct((at + p["loss_start"]).alias("start"), (at + p["loss_end"]).alias("end"))), lambda s: s["end"] > s["start"])
    return d.select("conv_id", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("formatted"), spans.alias("loss_spans"))


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of a table of whole turns: an event of kind message each. Rows that repeat a turn stay apart."""
    again = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()))
    return turns.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.struct("turn", again.alias("copy")).alias("message_id"), "role", "text")


def digests(rendered: DataFrame) -> DataFrame:
    """Of each conversation, read back from the rendered rows: runs of turns are joined first, then a conversation's runs."""
    r = rendered.withColumn("read", parse(F.col("rendered")))
    own = unescape(F.substring("rendered", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    r = r.select(
        "conv_id",
        F.floor(F.coalesce(F.col("seq"), F.lit(-1)) / RUN).alias("run"),
        F.struct("seq", "message_id", F.concat("read.role", F.lit("\n"), "read.text", F.lit("\n")).alias("turn"), own.alias("loss")).alias("part"),
        F.length("rendered").cast("long").alias("chars"),
    )
    runs = r.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("chars"), F.count("*").alias("n"))
    runs = runs.select("conv_id", "n", "chars", F.struct("run", F.array_join(F.transform("parts", lambda p: p["turn"]), "").alias("turns"), F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss")).alias("part"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"), F.sum("chars").alias("chars"), F.sum("n").alias("n"))
    turns = F.array_join(F.transform("parts", lambda p: p["turns"]), "")
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select(
        "conv_id",
        F.col("n").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trial = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trial).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(render(fold(turn_events(turns.repartition("conv_id")))))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS raw_role, text AS raw_text FROM conversations
  UNION ALL SELECT -7, k, r, '</s>[INST] ok [/INST]', r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)
), sized AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE:|/ROLE\])', '\1\\\2\3', 'g'))
    + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + length(url_encode(role)) END AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
