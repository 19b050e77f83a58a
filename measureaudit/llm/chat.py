"""Chat formatting: a finite-state machine over roles, and a declarative template with per-segment loss flags.

Only DataFrame functions are used. Conversations are formatted as a sequence of segments (text, loss); joined, the segment
texts are the formatted conversation. Control strings that occur inside a text are escaped, and ``read_back`` undoes it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table


@dataclass(frozen=True)
class Template:
    """names: how a role is written in the header. learn: roles whose text bears loss. moves: the machine's transitions, from
    "start" or a role to the roles that may follow. ends: the roles in which a conversation may end."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learn: tuple[str, ...] = ("assistant",)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("user", "assistant")
    before: str = "### "
    after_name: str = ": "
    close: str = " </turn>\n"

    @property
    def escapes(self) -> list[tuple[str, str]]:
        """In the order of escaping. Every escape is a backslash and a letter, so each can be undone by itself."""
        return [("\\", "\\s"), (self.before.strip(), "\\h"), (self.close.strip(), "\\e")]


DEFAULT = Template()


def escape(text: Column, t: Template = DEFAULT) -> Column:
    for raw, safe in t.escapes:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    for raw, safe in reversed(t.escapes):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _pairs(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _header(role: Column, t: Template) -> Column:
    other = F.concat(F.lit("\\r"), F.replace(escape(role, t), F.lit(":"), F.lit("\\c")))
    return F.concat(F.lit(t.before), F.coalesce(F.try_element_at(_pairs(t.names), role), other), F.lit(t.after_name))


def _role(name: Column, t: Template) -> Column:
    other = unescape(F.replace(F.substr(name, F.lit(3)), F.lit("\\c"), F.lit(":")), t)
    return F.coalesce(F.try_element_at(_pairs({v: k for k, v in t.names.items()}), name), other)


def format_chats(rows: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """(conv_id, valid, bad_turn, segments): one row per conversation of rows (conv_id, turn, role, text).

    segments is an array of (text, loss). valid says whether the turn order passes the machine; bad_turn is the 0-based place
    of the first turn that doesn't, or the number of turns if only the end is wrong, else null. Conversations that fail are
    formatted as well. Turns are ordered by turn, role, text (nulls first); repeated rows are kept, and fail the machine where
    a role repeats. A null text or role counts as empty; a role without a name in the template is written escaped and fails.
    Rows without conv_id are conversations of their own, one each, so that no group gathers them. An empty table gives an empty result; further columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    chats = rows.select("conv_id", alone, F.struct("turn", role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    move = _pairs({f"{a}>{b}": b for a, bs in t.moves.items() for b in bs})
    ran = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")),
        lambda acc, x: F.struct(
            F.coalesce(F.try_element_at(move, F.concat(acc.state, F.lit(">"), x.role)), F.lit("")).alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(acc.bad, F.when(F.try_element_at(move, F.concat(acc.state, F.lit(">"), x.role)).isNull(), acc["at"])).alias("bad"),
        ),
    )
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform("turns", lambda x: F.array(part(_header(x.role, t), F.lit(False)), part(escape(x.text, t), x.role.isin(*t.learn)), part(F.lit(t.close), F.lit(False))))
    )
    done = chats.select("conv_id", ran.alias("ran"), segments.alias("segments"))
    bad = F.coalesce("ran.bad", F.when(~F.col("ran.state").isin(*t.ends), F.col("ran.at")))
    return done.select("conv_id", bad.isNull().alias("valid"), bad.alias("bad_turn"), "segments")


def formatted(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def read_back(text: Column, t: Template = DEFAULT) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(text, "\\Q" + t.close + "\\E")
    name = lambda p: F.substring_index(F.substr(p, F.lit(len(t.before) + 1)), t.after_name, 1)
    turn = lambda p: F.struct(
        _role(name(p), t).alias("role"), unescape(F.substr(p, F.length(name(p)) + len(t.before) + len(t.after_name) + 1), t).alias("text")
    )
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(segments: Column, t: Template = DEFAULT) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text, t)), "")


PLANTED = "\\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with a planted one. Null texts count as empty, rows without conv_id are
    conversations of their own, repeated rows are turns of their own, an empty table gives the planted one alone; further columns are ignored."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = {"conv_id": F.lit(-7), "turn": F.col("id"), "role": F.when(F.col("id") == 0, "user").otherwise("assistant"), "text": F.lit(PLANTED)}
    more = spark.range(2).select(*[c.cast(given.schema[k].dataType).alias(k) for k, c in planted.items()])
    made = format_chats(given.unionByName(more)).withColumn("formatted", formatted(F.col("segments")))
    read = made.select("conv_id", "valid", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("learnt"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), k AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM c
), e AS (
  SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS next,
         replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e') AS safe
  FROM k WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || safe || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN role = 'system' THEN prev IS NULL AND next IS NOT NULL
                     WHEN role = 'user' THEN prev IS NULL OR prev <> 'user'
                     WHEN role = 'assistant' THEN coalesce(prev, '') = 'user' ELSE false END) AS valid
FROM e GROUP BY conv_id, alone
"""
