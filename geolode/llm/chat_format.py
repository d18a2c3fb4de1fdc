r"""Chat formatting by prefix-target expansion, with built-in expressions only.

Every assistant turn becomes an example: all turns before it as context and its own text as the only trainable part. A
conversation that does not end with an assistant turn gets one more example without a trainable part, so that its last turns
stay in the output. A turn is written as ``### role: text</turn>`` and a line end. Inside role and text, backslash, ``<``
and ``#`` (in roles ``:`` too) become a backslash and a letter, so no text can hold a control string, and reading back
undoes it.

Conversations are handled in blocks of 256 turn numbers; where so many rows have neighbouring or equal turn numbers (or none) that a
block would hold over ``CROWDED`` of them, these are sorted over all tasks and cut into blocks of 256 rows. An example is
written as one part for each block up to its own, and parts are dealt out over all tasks, so a very long conversation neither meets in
one task nor in one row. The part of an example's own block is made where the block is; only conversations of several blocks are joined with
the blocks before. (``digests`` needs all turns of a conversation in one row, as they are one input of a hash; a row holds up to 2 GB.)

Turns are ordered by turn number (nulls first), then role and text. Null role or text counts as empty, and rows with a null
conv_id form one conversation. Repeated rows are turns of their own. An empty table gives no examples. Further
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import saved, small_side

#: Turn numbers of a block, and rows beyond which a block is cut by rows.
BLOCK, CROWDED = 256, 1024
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
#: What is escaped, backslash first, and by which letter.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
ASSISTANT = "assistant"


def escaped(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, value)


def unescaped(value: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[1]), F.lit(p[0])), reversed(pairs), value)


def _written(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(turn["role"], ROLE_ESCAPES), F.lit(BETWEEN), escaped(turn["text"], ESCAPES), F.lit(CLOSE))


def blocks(turns: DataFrame) -> DataFrame:
    """Key (conv, none: whether conv_id is null), block (number, cut) and its turns in order."""
    number = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    keyed = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("none"),
        number.alias("number"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    key = ["conv", "none", "number"]
    crowded = saved(keyed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).drop("n"))
    n = crowded.count()
    cut = keyed.withColumn("cut", F.lit(0).cast("long"))
    if n:
        order = [*key, "turn", "role", "text"]
        many = keyed.join(small_side(crowded, n, 32), key).repartitionByRange(*order).sortWithinPartitions(*order)
        # the running number rises over the sorted tasks
        many = many.withColumn("cut", F.floor(F.monotonically_increasing_id() / BLOCK).cast("long"))
        # saved, as the numbers of a range that is dealt anew need not be the same
        cut = cut.join(small_side(crowded, n, 32), key, "left_anti").unionByName(saved(many))
    turn = F.struct("turn", "role", "text")
    grouped = cut.withColumn("block", F.struct("number", "cut")).groupBy("conv", "none", "block").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped


def examples(turns: DataFrame) -> DataFrame:
    """A row per example and part: conv_id, block and place (of the example's last turn), part, text, complete, loss_start, loss_end.

    The example's text is its parts in order; complete says that the part has all turns of its block. The code points from loss_start to
    loss_end (exclusive) of its last part are trainable. Both are null in other parts and in examples without a trainable part.
    """
    grouped, key = blocks(turns), ["conv", "none"]
    last = F.max(F.struct("block", (F.size("turns") - 1).alias("place"), F.element_at("turns", -1)["role"].alias("role")))
    ends = grouped.groupBy(*key).agg(last.alias("last"), F.count("*").alias("blocks"))
    tails = ends.filter(F.col("last.role") != ASSISTANT).select(*key, F.col("last.block").alias("block"), F.col("last.place").alias("tail"))
    places = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.col("turns")[i]["role"] == ASSISTANT)
    places = F.when(F.col("tail").isNotNull(), F.concat(places, F.array("tail"))).otherwise(places)
    # grouped stays where it is, dealt by conversation and block
    own = grouped.join(tails, [*key, "block"], "left").withColumn("place", F.explode(places))
    conv_id = F.when(~F.col("none"), F.col("conv")).alias("conv_id")
    target = F.col("turns")[F.col("place")]
    own = own.withColumns({"text": F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("place") + 1), _written), ""), "size": F.when(target["role"] == ASSISTANT, F.length(escaped(target["text"], ESCAPES)))})
    end = F.length("text") - len(CLOSE)
    first = own.select(conv_id, "block", "place", F.col("block").alias("part"), "text", (F.col("place") + 1 == F.size("turns")).alias("complete"), (end - F.col("size")).cast("long").alias("loss_start"), F.when(F.col("size").isNotNull(), end).cast("long").alias("loss_end"))
    long = saved(ends.filter("blocks > 1").select(*key))
    n = long.count()
    if not n:
        return first
    long = small_side(long, n, 16)
    parts = grouped.join(long, key).select(*key, F.col("block").alias("part"), F.array_join(F.transform("turns", _written), "").alias("text"))
    whole = own.join(long, key).select(*key, "block", "place").join(parts, key).filter(F.col("part") < F.col("block"))
    none = F.lit(None).cast("long")
    return first.unionByName(whole.select(conv_id, "block", "place", "part", "text", F.lit(True).alias("complete"), none.alias("loss_start"), none.alias("loss_end")))


def read_turns(text: Column) -> Column:
    """The (role, text) structs that a formatted text holds."""
    written = F.filter(F.split(text, CLOSE), lambda x: x != "")
    cut = lambda x: F.instr(x, BETWEEN)
    role = lambda x: unescaped(F.substring(x, F.lit(len(OPEN) + 1), cut(x) - len(OPEN) - 1), ROLE_ESCAPES)
    return F.transform(written, lambda x: F.struct(role(x).alias("role"), unescaped(F.substring(x, cut(x) + len(BETWEEN), F.length(x)), ESCAPES).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of a part."""
    return unescaped(F.substring(text, (start + 1).cast("int"), (end - start).cast("int")), ESCAPES)


def digests(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from its examples: complete parts hold all turns, and each example its own trainable text."""
    loss = F.when(F.col("loss_end").isNotNull(), read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")))
    # what is measured and read before the shuffle: lengths, trainable texts, and one copy of each complete part in a task
    read = formatted.select("conv_id", F.length("text").alias("chars"), F.when(F.col("complete"), F.struct("part", "text")).alias("whole"), F.when(loss.isNotNull(), F.struct("block", "place", loss.alias("loss"))).alias("loss"))
    joined = lambda parts, field: F.array_join(F.sort_array(parts)[field], "")
    df = read.groupBy("conv_id").agg(F.sum("chars").cast("long").alias("formatted_chars"), joined(F.collect_set("whole"), "text").alias("text"), joined(F.collect_list("loss"), "loss").alias("loss"))
    df = df.withColumn("turns", read_turns(F.col("text")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, 14 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM s)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
