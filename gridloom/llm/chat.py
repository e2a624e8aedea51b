"""Chat formatting in relational form: Spark expressions only.

The turns of a conversation are collected as structs and sorted; an array aggregation merges neighbours of one role into
blocks; the blocks are concatenated by a template. Every text is escaped first, so that none of the template's control
strings can occur inside a text, and escaping can be undone: back-slashes are doubled, and a back-slash goes behind
the first character of a control string. ``parse`` reads the turns back from the formatted string alone, and
``masked_text`` what the loss mask covers.

The mask is a list of runs, one a turn: ``marks`` characters of the template, never under the loss, then ``chars``
characters of text, under the loss or not. Lengths are in code points.

Conversations of more than CHUNK_TURNS rows are formatted in pieces by ranges of their turn numbers, each piece in a
group of its own, and the pieces are joined like turns are: at a border within one role with the mark between texts. So
a conversation with a third of all rows is many groups, then one row a piece; its result is one string all the same.

A null text or role counts as empty; a null turn comes first; turns of equal number are in the order of role, then
text; repeated rows are turns of their own; a null conversation id is a conversation. Very long texts stay in one row.
Only the four named columns are read, so further columns cannot clash. An empty table has no conversations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import stage
from gridloom.types import column

from .common import register, table

CHUNK_TURNS = 256


@dataclass(frozen=True)
class Template:
    """A block is ``begin`` role ``head`` text (``between`` text)* ``tail`` ``end``.

    The control strings must differ, have two characters at least and no back-slash, and begin with a character that
    no control string has further on.
    """

    begin: str = "<s>"
    head: str = "[INST]"
    between: str = "[AND]"
    tail: str = "[/INST]"
    end: str = "</s>"

    def __post_init__(self):
        marks = self.marks()
        firsts = {m[:1] for m in marks}
        if len(set(marks)) < 5 or any(len(m) < 2 or "\\" in m or firsts & set(m[1:]) for m in marks):
            raise ValueError("control strings cannot be told apart")

    def marks(self) -> list[str]:
        return [self.begin, self.head, self.between, self.tail, self.end]

    def pattern(self) -> str:
        """A control string, cut behind its first character."""
        return "|".join(f"(?<={_quoted(m[0])})(?={_quoted(m[1:])})" for m in self.marks())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), self.pattern(), r"\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(\\?)", "$1")


def _quoted(mark: str) -> str:
    return re.sub(r"([^\w/])", r"\\\1", mark)


TEMPLATE = Template()

PIECE = "struct<first:string,last:string,body:string,runs:array<struct<marks:int,chars:int,loss:boolean>>>"
BLOCK = "array<struct<role:string,at:int,n:int>>"


def blocks_of(turns: Column) -> Column:
    """Neighbouring turns of one role as (role, place of the first, how many)."""

    def step(done: Column, turn: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["role"].alias("role"), last["at"].alias("at"), (last["n"] + 1).alias("n"))
        fresh = F.struct(turn["role"].alias("role"), F.coalesce(last["at"] + last["n"], F.lit(0)).alias("at"), F.lit(1).alias("n"))
        return F.when(last["role"] == turn["role"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(
            F.concat(done, F.array(fresh))
        )

    return F.aggregate(turns, F.array().cast(BLOCK), step)


def block_piece(block: Column, turns: Column, loss_role: str, template: Template) -> Column:
    """A block without its opening and closing."""
    texts = F.transform(F.slice(turns, block["at"] + 1, block["n"]), lambda t: t["text"])
    runs = F.transform(texts, lambda t, i: F.struct(
        F.when(i > 0, F.lit(len(template.between))).otherwise(0).alias("marks"), F.length(t).alias("chars"),
        (block["role"] == loss_role).alias("loss"),
    ))
    return F.struct(
        block["role"].alias("first"), block["role"].alias("last"), F.array_join(texts, template.between).alias("body"), runs.alias("runs"),
    ).cast(PIECE)


def opening(role: Column, template: Template) -> Column:
    return F.concat(F.lit(template.begin), template.escape(role), F.lit(template.head))


def joined(pieces: Column, template: Template) -> Column:
    """Pieces as one, with what belongs between two of them."""

    def joint(piece: Column, i: Column) -> Column:
        before = F.get(pieces, i - 1)["last"]
        turned = F.concat(F.lit(template.tail + template.end), opening(piece["first"], template))
        return F.when(i == 0, F.lit("")).when(before == piece["first"], F.lit(template.between)).otherwise(turned)

    def runs(piece: Column, i: Column) -> Column:
        head = F.get(piece["runs"], F.lit(0))
        first = F.struct((head["marks"] + F.length(joint(piece, i))).alias("marks"), head["chars"].alias("chars"), head["loss"].alias("loss"))
        return F.concat(F.array(first), F.slice(piece["runs"], 2, F.size(piece["runs"])))

    return F.struct(
        F.get(pieces, F.lit(0))["first"].alias("first"), F.get(pieces, F.size(pieces) - 1)["last"].alias("last"),
        F.array_join(F.transform(pieces, lambda p, i: F.concat(joint(p, i), p["body"])), "").alias("body"),
        F.flatten(F.transform(pieces, runs)).alias("runs"),
    ).cast(PIECE)


def format_chats(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant", template: Template = TEMPLATE, chunk_turns: int = CHUNK_TURNS,
) -> DataFrame:
    """(conv, formatted, runs): a row for each conversation, its formatted string and its loss mask."""
    empty = F.lit("")
    rows = df.select(
        column(conv).alias("conv"), column(turn).alias("turn"), F.coalesce(column(role).cast("string"), empty).alias("role"),
        F.coalesce(column(text).cast("string"), empty).alias("text"),
    )
    many = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > chunk_turns).select("conv")
    many = stage(many, "long-chats").select(F.col("conv").alias("long"))  # written, so that its real size decides on the join
    is_long = F.col("conv").eqNullSafe(F.col("long"))

    def pieces(of: DataFrame, *keys: str) -> DataFrame:
        in_order = of.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("raw"))
        safe = F.transform("raw", lambda t: F.struct(t["role"].alias("role"), template.escape(t["text"]).alias("text")))
        sorted_turns = in_order.select(*keys, safe.alias("turns")).withColumn("blocks", blocks_of(F.col("turns")))
        each = F.transform("blocks", lambda b: block_piece(b, F.col("turns"), loss_role, template))
        return sorted_turns.withColumn("pieces", each).select(*keys, joined(F.col("pieces"), template).alias("piece"))

    short = pieces(rows.join(many, is_long, "left_anti"), "conv")
    long = rows.join(many, is_long, "left_semi").withColumn("part", F.floor(F.col("turn") / chunk_turns))
    parts = pieces(long, "conv", "part").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("parts"))
    whole = parts.withColumn("pieces", F.transform("parts", lambda p: p["piece"])).select("conv", joined(F.col("pieces"), template).alias("piece"))
    head = opening(F.col("piece.first"), template)
    first = F.get("piece.runs", F.lit(0))
    opened = F.struct((first["marks"] + F.length(head)).alias("marks"), first["chars"].alias("chars"), first["loss"].alias("loss"))
    return short.unionAll(whole).select(
        F.col("conv").alias(conv), F.concat(head, F.col("piece.body"), F.lit(template.tail + template.end)).alias("formatted"),
        F.concat(F.array(opened), F.slice("piece.runs", 2, F.size("piece.runs"))).alias("runs"),
    )


def parse(formatted: Column, template: Template = TEMPLATE) -> Column:
    """array<struct<role, text>>: the turns, read back from the formatted string; texts are still escaped."""
    blocks = F.split(formatted, _quoted(template.end))

    def turns(block: Column) -> Column:
        parts = F.split(block, _quoted(template.head))
        role = template.unescape(F.substring(F.get(parts, F.lit(0)), len(template.begin) + 1, 1 << 30))
        body = F.split(F.get(parts, F.lit(1)), _quoted(template.tail))
        return F.transform(F.split(F.get(body, F.lit(0)), _quoted(template.between)), lambda t: F.struct(role.alias("role"), t.alias("text")))

    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def masked_text(turns: Column, runs: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, with nothing between; null where the mask does not fit the turns."""
    fits = (F.size(turns) == F.size(runs)) & F.forall(F.zip_with(turns, runs, lambda t, r: F.length(t["text"]) == r["chars"]), lambda ok: ok)
    held = F.filter(turns, lambda t, i: F.get(runs, i)["loss"])
    return F.when(fits, F.array_join(F.transform(held, lambda t: template.unescape(t["text"])), ""))


#: The conversation that the query adds: control strings as text.
ADDED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]

_ESCAPED = r"regexp_replace(replace({}, '\', '\\'), '([<\[])(s>|/s>|INST\]|/INST\]|AND\])', '\1\\\2', 'g')"
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {', '.join(map(str, ADDED))})
), e AS (
  SELECT *, {_ESCAPED.format('text')} AS safe, {_ESCAPED.format('role')} AS safe_role,
         role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS opens
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN opens THEN 20 + length(safe_role) ELSE 5 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@register("op12_chat_formatting", SQL)
def op12(spark, sf_dir):
    """Every conversation and one of control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = format_chats(rows.unionAll(spark.createDataFrame(ADDED, "conv_id bigint, turn bigint, role string, text string")))
    read = chats.withColumn("turns", parse(F.col("formatted")))
    read = read.withColumn("loss", masked_text(F.col("turns"), F.col("runs")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), TEMPLATE.unescape(t["text"]), F.lit("\n"))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
