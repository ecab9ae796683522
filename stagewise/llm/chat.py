r"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are laid out on a line by the running sum of their
tokens (the opening system turn aside). The line is cut into cells of
``budget - history - system tokens``. The turns that lie inside one cell make
one window, and a turn that crosses a cell border makes a window of its own:
a window never passes the budget unless a single turn does. Every later window
opens with the system turn again and with the whole turns that start within
``history`` tokens before it; these repeats are not in the loss mask, which
holds each assistant text once.

Template: ``<turn ROLE>TEXT</turn>``, turn after turn. Inside roles and texts
``\`` is written ``\b``, ``<`` is ``\l`` and ``>`` is ``\g``, so no text can hold
a control string, and the replacement can be undone in any text.

Tokens are estimated as 4 for a turn's marks and one for four characters; an
expression over ``role`` and ``text`` can take its place.

Output rows: ``conv_id``, ``part`` (ascending in the conversation), ``formatted``,
``n_repeated`` (turns that are repeats, all in front), ``loss`` (start and length
of each trained text in ``formatted``, in code points), ``tokens``.

Defined results: a null role or text is an empty one; a null conversation id
is one conversation; turns are ordered by number (null first), then role and
text, and equal rows are turns of their own; an empty table gives no windows;
further columns are not read. The turns of one conversation meet in one group,
as the digest of a whole conversation needs them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import staged

BUDGET = 256
HISTORY = 64
TURN_TOKENS = "4 + CAST(ceil(char_length(text) / 4) AS BIGINT)"

#: Fixed values of the template.
OPEN, CLOSE_ROLE, CLOSE = "<turn ", ">", "</turn>"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, turn_tokens: str = TURN_TOKENS) -> DataFrame:
    """The formatted windows of all conversations."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("n", F.greatest(F.expr(turn_tokens).cast("bigint"), F.lit(1)))
    conv = Window.partitionBy("conv_id")
    turns = turns.withColumn("pos", F.row_number().over(conv.orderBy("turn", "role", "text")))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    line = conv.orderBy("pos")
    turns = turns.withColumn("head", system).withColumn("line_n", F.when(system, 0).otherwise(F.col("n")))
    turns = turns.withColumn("start", F.sum("line_n").over(line) - F.col("line_n"))
    turns = turns.withColumn("head_turn", F.first(F.when(system, F.struct("role", "text", "n")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    cell = F.greatest(F.lit(budget - history) - F.coalesce(F.col("head_turn")["n"], F.lit(0)), F.lit(1))
    first, last = F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("line_n") - 1) / cell)
    turns = turns.withColumn("part", F.when(~F.col("head"), 2 * first + (first != last).cast("bigint")))
    turns = turns.withColumn("opening", F.coalesce(F.min("part").over(conv), F.lit(0)))
    turns = turns.withColumn("part", F.coalesce("part", "opening"))
    near = F.collect_list(F.when(~F.col("head"), F.struct("start", "role", "text", "n"))).over(conv.orderBy("start").rangeBetween(-history, 0))
    turns = turns.withColumn("near", near)
    begins = F.lag("part").over(line).isNull() | (F.lag("part").over(line) != F.col("part"))
    past = F.filter("near", lambda x: x["start"] < F.col("start"))
    turns = turns.withColumn("past", F.when(begins, F.transform(past, lambda x: F.struct(x["role"], x["text"], x["n"]))))
    parts = turns.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "text", "n"))).alias("new"),
        F.first("past", ignorenulls=True).alias("past"),
        F.first(F.when(F.col("part") > F.col("opening"), F.col("head_turn")), ignorenulls=True).alias("again"),
    )
    repeated = F.concat(F.when(F.col("again").isNotNull(), F.array("again")).otherwise(F.slice("past", 1, 0)), F.col("past"))
    coded = lambda x, new: F.struct(
        F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE_ROLE)).alias("mark"),
        escape(x["text"]).alias("body"),
        (F.lit(new) & (x["role"] == "assistant")).alias("trained"),
    )
    parts = parts.withColumn("repeated", repeated)
    parts = parts.withColumn("pieces", F.concat(F.transform("repeated", lambda x: coded(x, False)), F.transform("new", lambda x: coded(x, True))))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS array<struct<start:bigint,length:bigint>>)").alias("spans"))
    spans = F.aggregate(
        "pieces",
        begin,
        lambda s, x: F.struct(
            (s["at"] + F.char_length(x["mark"]) + F.char_length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(
                x["trained"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + F.char_length(x["mark"])).alias("start"), F.char_length(x["body"]).cast("bigint").alias("length")))),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return parts.select(
        "conv_id",
        "part",
        F.array_join(F.transform("pieces", lambda x: F.concat(x["mark"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.size("repeated").alias("n_repeated"),
        spans["spans"].alias("loss"),
        (total("repeated") + total("new")).alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from windows alone: its turns, the trained text and the length of all windows."""
    pieces = F.split("formatted", CLOSE, -1)
    role = lambda x: unescape(F.substring(x, F.lit(len(OPEN) + 1), F.instr(x, CLOSE_ROLE) - len(OPEN) - 1))
    body = lambda x: unescape(F.substring(x, F.instr(x, CLOSE_ROLE) + 1, F.char_length(x)))
    rows = formatted.withColumn("piece", F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated")))
    rows = rows.select(
        "conv_id",
        "part",
        F.size("piece").cast("bigint").alias("n"),
        F.array_join(F.transform("piece", lambda x: F.concat(role(x), F.lit("\n"), body(x), F.lit("\n"))), "").alias("turns"),
        F.array_join(F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))), "").alias("trained"),
        F.char_length("formatted").cast("bigint").alias("chars"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "turns", "trained"))).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.transform("parts", lambda x: x["turns"]), "").alias("turns"),
        F.array_join(F.transform("parts", lambda x: x["trained"]), "").alias("trained"),
        "formatted_chars",
    )


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7 of the contract, whose texts look like control strings."""
    said = r"r'\### Assistant: </turn> ok'"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, from windows that were written and read again."""
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(control_conversation(conversations.sparkSession))
    got = read_back(staged(windows(rows), "chat-windows"))
    return got.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = rf"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, 4 + CAST(ceil(length(text) / 4.0) AS BIGINT) AS n,
         14 + length(role) + length(text)
           + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM raw
), headed AS (
  SELECT *, pos = 1 AND role = 'system' AS head, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE n END AS line_n FROM placed
), lined AS (
  SELECT *, sum(line_n) OVER w - line_n AS start,
         greatest({BUDGET - HISTORY} - coalesce(max(CASE WHEN head THEN n END) OVER (PARTITION BY conv_id), 0), 1) AS cell,
         coalesce(max(CASE WHEN head THEN chars END) OVER (PARTITION BY conv_id), 0) AS head_chars
  FROM headed WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), cut AS (
  SELECT *, CASE WHEN head THEN NULL ELSE 2 * (start // cell) + CAST(start // cell <> (start + line_n - 1) // cell AS INT) END AS own FROM lined
), parted AS (
  SELECT *, coalesce(own, min(own) OVER (PARTITION BY conv_id), 0) AS part, coalesce(min(own) OVER (PARTITION BY conv_id), 0) AS opening FROM cut
), firsts AS (
  SELECT conv_id, part, min(start) AS start, any_value(opening) AS opening, any_value(head_chars) AS head_chars FROM parted GROUP BY conv_id, part
), repeats AS (
  SELECT f.conv_id,
         sum(CASE WHEN f.part > f.opening THEN f.head_chars ELSE 0 END) AS heads
  FROM firsts f GROUP BY f.conv_id
), past AS (
  SELECT f.conv_id, sum(p.chars) AS chars FROM firsts f
  JOIN parted p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND NOT p.head AND p.start < f.start AND f.start - p.start <= {HISTORY}
  GROUP BY f.conv_id
), told AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
         sum(chars) AS chars
  FROM placed GROUP BY conv_id
)
SELECT told.conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
       CAST(told.chars + repeats.heads + coalesce(past.chars, 0) AS BIGINT) AS formatted_chars
FROM told JOIN repeats ON repeats.conv_id IS NOT DISTINCT FROM told.conv_id
LEFT JOIN past ON past.conv_id IS NOT DISTINCT FROM told.conv_id
"""
