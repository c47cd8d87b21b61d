"""Chat formatting: a state machine over roles, a declarative template, text segments with loss flags, and the way back.

Built from DataFrame functions alone. Turns are put together by blocks of 64 turn numbers first and
the blocks by conversation, so that a very long conversation is escaped and formatted by many tasks;
only its finished blocks meet in one row, which the formatted conversation is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_BLOCK_BITS = 6  # 64 turn numbers a block


@dataclass(frozen=True)
class Role:
    """What stands before and after a turn of this role, and whether its text is learnt."""

    opening: str
    closing: str
    learnt: bool = False


@dataclass(frozen=True)
class Template:
    """``roles`` by name; ``moves``: (state, role, next state) of the machine over turns, which starts in
    the first move's state, fails where no move fits, and must end in one of ``ends``. A turn of a role
    that is not named opens with its name between ``name_opening`` and ``name_closing`` and ends with
    ``closing``; no move fits it. ``escape`` is one character that no marker holds."""

    roles: dict[str, Role]
    moves: tuple[tuple[str, str, str], ...]
    ends: tuple[str, ...]
    name_opening: str = "[ROLE]"
    name_closing: str = "[/ROLE]"
    closing: str = "</s>"
    escape: str = "\\"

    def __post_init__(self) -> None:
        openings = [self.name_opening, *[r.opening for r in self.roles.values()]]
        if len(set(openings)) < len(openings) or set(openings) & set(self.closings):
            raise ValueError("each opening must differ from the other markers")
        if len(self.escape) != 1 or any(len(m) < 2 or self.escape in m for m in self.markers):
            raise ValueError("markers have two characters or more, none of them the escape character")
        for a in self.markers:
            for cut in range(1, len(a)):
                # Else the end of a text and the start of a marker could look like another marker.
                if any(b.startswith(a[cut:]) or a[cut:].startswith(b) for b in self.markers):
                    raise ValueError(f"marker {a!r} runs into another")
        if any(role not in self.roles for _, role, _ in self.moves):
            raise ValueError("a move names a role that the template does not have")

    @property
    def closings(self) -> list[str]:
        return sorted({self.closing, *[r.closing for r in self.roles.values()]})

    @property
    def markers(self) -> list[str]:
        return sorted({self.name_opening, self.name_closing, *self.closings, *[r.opening for r in self.roles.values()]})


#: Instructions and answers; a system text may come first.
INSTRUCT = Template(
    roles={"system": Role("<<SYS>>", "<</SYS>>"), "user": Role("[INST]", "[/INST]"), "assistant": Role("[ANS]", "</s>", learnt=True)},
    moves=(
        ("start", "system", "primed"), ("start", "user", "asked"), ("primed", "user", "asked"),
        ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    ),
    ends=("answered",),
)


def escaped(text: Column, template: Template) -> Column:
    """``text`` without any of the template's markers: the escape character is doubled, and one is put
    behind the first character of each marker."""
    escape = re.escape(template.escape)
    heads = "|".join(f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m in template.markers)
    in_replacement = "\\" + template.escape
    doubled = F.regexp_replace(text, F.lit(escape), F.lit(in_replacement * 2))
    return F.regexp_replace(doubled, F.lit(heads), F.lit("$0" + in_replacement))


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, F.lit(f"(?s){re.escape(template.escape)}(.)"), F.lit("$1"))


def _segments(turn: Column, template: Template) -> Column:
    """Opening, text and closing of a turn, each with its loss flag."""
    by_role = lambda pick, other: F.coalesce(*[F.when(turn["role"] == name, pick(r)) for name, r in template.roles.items()], other)
    named = F.concat(F.lit(template.name_opening), escaped(turn["role"], template), F.lit(template.name_closing))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.array(
        segment(by_role(lambda r: F.lit(r.opening), named), F.lit(False)),
        segment(escaped(turn["text"], template), by_role(lambda r: F.lit(r.learnt), F.lit(False))),
        segment(by_role(lambda r: F.lit(r.closing), F.lit(template.closing)), F.lit(False)),
    )


def _machine(roles: Column, template: Template) -> Column:
    """(state, place, failed_at) after running the machine over the role numbers; state 0 is failure."""
    states = ["", *dict.fromkeys(s for a, _, b in template.moves for s in (a, b))]
    names = list(template.roles)
    goes = {(states.index(a), names.index(r) + 1): states.index(b) for a, r, b in template.moves}
    table = F.array(*[F.lit(goes.get((s, r), 0)) for s in range(len(states)) for r in range(len(names) + 1)])

    def step(run: Column, role: Column) -> Column:
        state = F.element_at(table, run["state"] * (len(names) + 1) + role + 1)
        failed = F.when((state == 0) & run["failed_at"].isNull(), run["place"]).otherwise(run["failed_at"])
        return F.struct(state.alias("state"), (run["place"] + 1).alias("place"), failed.alias("failed_at"))

    start = F.struct(F.lit(1).alias("state"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("long").alias("failed_at"))
    end = lambda run: F.struct(run["state"].isin([states.index(s) for s in template.ends]).alias("valid"), run["failed_at"].alias("failed_at"))
    return F.aggregate(roles, start, step, end)


def format_chats(turns: DataFrame, template: Template = INSTRUCT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: the id, n_turns, valid, failed_at, segments and formatted.

    ``segments`` is an array of (text, loss) in order; ``formatted`` is their texts joined. ``valid``
    tells whether the machine took every turn and ended well; ``failed_at`` is the place, from 0, of
    the first turn that no move fitted (null if there is none). Conversations out of order are formatted
    all the same. Turns go by turn number, nulls first; equal numbers by role, then text; equal rows
    stay. A null role is the empty name and a null text the empty text. Rows of a null id form one
    conversation. Other columns are not read; an empty table gives an empty one. A conversation is
    one row and so limited to what Spark keeps in one (2 GB); texts may have any length below that.
    """
    names = list(template.roles)
    rows = turns.select(
        F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    blocks = rows.groupBy("id", F.shiftright("turn", _BLOCK_BITS).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    number = lambda turn: F.array_position(F.array(*[F.lit(n) for n in names]), turn["role"]).cast("int")
    made = blocks.select("id", "block", F.struct(
        "block", F.transform("turns", number).alias("roles"),
        F.flatten(F.transform("turns", lambda turn: _segments(turn, template))).alias("segments"),
    ).alias("part"))
    whole = made.groupBy("id").agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        "id", F.flatten("parts.roles").alias("roles"), F.flatten("parts.segments").alias("segments"))
    return whole.select("id", "roles", "segments", _machine(F.col("roles"), template).alias("end")).select(
        F.col("id").alias(id_col), F.size("roles").cast("long").alias("n_turns"), "end.valid", "end.failed_at",
        "segments", F.array_join("segments.text", "").alias("formatted"),
    )


def read_turns(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns that a formatted conversation was made of: an array of (role, text), unescaped."""
    opening = "|".join(re.escape(m) for m in [template.name_opening, *[r.opening for r in template.roles.values()]])
    closing = "|".join(re.escape(m) for m in template.closings)
    pattern = F.lit(f"(?s)({opening})(.*?)(?:{closing})")
    heads, bodies = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))

    def turn(head: Column, body: Column) -> Column:
        named = head == template.name_opening
        name = F.substring_index(body, template.name_closing, 1)
        rest = F.substr(body, F.char_length(name) + F.lit(len(template.name_closing) + 1))
        known = F.coalesce(*[F.when(head == r.opening, F.lit(n)) for n, r in template.roles.items()])
        return F.struct(
            F.when(named, unescaped(name, template)).otherwise(known).alias("role"),
            unescaped(F.when(named, rest).otherwise(body), template).alias("text"),
        )

    return F.zip_with(heads, bodies, turn)


def learnt_text(segments: Column, template: Template = INSTRUCT) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"], template)), "")
