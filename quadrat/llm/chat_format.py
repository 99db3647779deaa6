"""Chat formatting by a finite-state machine over roles.

A template states the markers of a turn, the roles whose text is trained on and
the machine: for each state (the role read last, ``start`` at first) the roles
that may follow, and the roles a conversation may end on.  A window over the
turns of a conversation reads the state before each turn, so the machine runs
without gathering a conversation in memory.  Each turn becomes segments (text,
loss); control characters of a text are escaped, so no text can forge a marker
and the original comes back exactly.

Defined results
- null text or role: empty; null turn: sorts first; ties: by role, then text
- repeated rows are turns of their own; a null conv_id is a conversation
- an unknown role or a wrong order makes the conversation invalid from that
  turn; it is formatted all the same and marked
- empty table: empty result; extra columns are ignored, whatever their names
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.llm.common import digest


@dataclass(frozen=True)
class Template:
    """Markers, machine and loss of a chat format.

    ``escapes`` are (character, code) pairs; the first is that of the escape
    character itself.  Every marker must hold one of the escaped characters.
    """

    before_role: str = "### "
    after_role: str = ": "
    after_text: str = " </turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("#", "\\h"), ("<", "\\l"))
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)


PLAIN = Template()


def escape(c: Column, pairs) -> Column:
    """Each escaped character as its code; the escape character first."""
    for char, code in pairs:
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape(c: Column, pairs) -> Column:
    """The inverse: every escape character starts a code, so order is free but for its own, which is last."""
    for char, code in reversed(pairs):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def segments(turns: DataFrame, template: Template = PLAIN) -> DataFrame:
    """One row a turn: conv_id, position, role, segments (text, loss), allowed, ok_so_far.

    The main output for training at scale; a conversation is never gathered.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("position", F.row_number().over(in_order)).withColumn("state", F.lag("role", 1, "start").over(in_order))
    moves = [F.col("state").eqNullSafe(s) & F.col("role").isin(*to) for s, to in template.follows.items()]
    # a role that is itself called "start" is unknown to the machine and can't stand for its first state
    first = F.col("position") == 1
    allowed = F.lit(False)
    for (s, _), move in zip(template.follows.items(), moves, strict=True):
        allowed = allowed | (move & (first if s == "start" else ~first))
    loss = F.col("role").isin(*template.loss_roles)
    seg = lambda text, on: F.struct(text.alias("text"), on.alias("loss"))
    opening = F.concat(F.lit(template.before_role), escape(F.col("role"), template.escapes + template.role_escapes), F.lit(template.after_role))
    parts = F.array(seg(opening, F.lit(False)), seg(escape(F.col("text"), template.escapes), loss), seg(F.lit(template.after_text), F.lit(False)))
    t = t.withColumn("allowed", allowed)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "position", "role", parts.alias("segments"), "allowed", F.min("allowed").over(so_far).alias("ok_so_far"))


def conversations(turns: DataFrame, template: Template = PLAIN) -> DataFrame:
    """One row a conversation: conv_id, formatted, segments, n_turns, valid, first_bad_turn.

    A row of the result is a whole conversation, so it is as long as that is.
    The grouping uses the partitioning of the window: there is one shuffle.
    """
    s = segments(turns, template)
    g = s.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "segments"))).alias("turns"),
        F.count("*").alias("n_turns"),
        F.min("allowed").alias("in_order"),
        F.max_by("role", "position").alias("last_role"),
        F.min(F.when(~F.col("allowed"), F.col("position"))).alias("first_bad_turn"),
    )
    parts = F.flatten(F.transform("turns", lambda t: t["segments"]))
    g = g.select("conv_id", parts.alias("segments"), "n_turns", (F.col("in_order") & F.col("last_role").isin(*template.ends)).alias("valid"), "first_bad_turn")
    return g.withColumn("formatted", F.array_join(F.transform("segments", lambda p: p["text"]), ""))


def read_back(formatted: Column, template: Template = PLAIN) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"\Q" + template.after_text + r"\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    start = len(template.before_role)

    def turn(p: Column) -> Column:
        end = F.instr(p, template.after_role)
        role = F.substring(p, F.lit(start + 1), end - start - 1)
        text = F.substring(p, end + len(template.after_role), F.length(p))
        return F.struct(unescape(role, template.escapes + template.role_escapes).alias("role"), unescape(text, template.escapes).alias("text"))

    return F.transform(pieces, turn)


def trained_text(parts: Column, template: Template = PLAIN) -> Column:
    """The text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["loss"]), lambda p: unescape(p["text"], template.escapes)), "")


def digests(formatted: DataFrame, template: Template = PLAIN) -> DataFrame:
    """Figures read back from the output of ``conversations``."""
    f = formatted.withColumn("back", read_back(F.col("formatted"), template)).withColumn("learnt", trained_text(F.col("segments"), template))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        digest(told).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        digest(F.col("learnt")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
