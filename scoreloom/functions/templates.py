"""Chat templates as column builders."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom import constants as K


@dataclass(frozen=True)
class Template:
    """How a turn is written, and what asks the assistant for the next one.

    ``roles`` lists the roles that are written (``None``: all of them), turns of
    other roles are dropped. ``opener_after`` limits the opener to conversations
    that end with that role.
    """

    turn: Callable[[Column, Column], Column]
    opener: str
    roles: tuple[str, ...] | None = None
    opener_after: str | None = None

    def shows(self, role: Column) -> Column:
        return F.lit(True) if self.roles is None else role.isin(*self.roles)

    def opening(self, last_role: Column) -> Column:
        if self.opener_after is None:
            return F.lit(self.opener)
        return F.when(last_role == self.opener_after, F.lit(self.opener)).otherwise(F.lit(""))

    def render_turns(self, turns: Sequence[tuple[str, Column]], ask: bool = False) -> Column:
        """Text of turns whose roles are known when the plan is built."""
        shown = [t for t in turns if self.roles is None or t[0] in self.roles]
        parts = [self.turn(F.lit(role), content) for role, content in shown]
        if ask and turns:
            parts.append(self.opening(F.lit(turns[-1][0])))
        return F.concat(F.lit(""), *parts)

    def render(self, messages: Column, ask: bool = False) -> Column:
        """Text of an array of ``{role, content}``."""
        shown = messages if self.roles is None else F.filter(messages, lambda m: self.shows(m["role"]))
        text = F.array_join(F.transform(shown, lambda m: self.turn(m["role"], m["content"])), "")
        if not ask:
            return text
        last = F.get(messages, F.size(messages) - 1)["role"]
        return F.concat(text, self.opening(last))


CHATML = Template(
    turn=lambda role, content: F.concat(
        F.lit(K.TURN_START), role, F.lit("\n"), content, F.lit(K.TURN_END + "\n")
    ),
    opener=f"{K.TURN_START}assistant\n",
    roles=("system", "user", "assistant"),
)
PLAIN = Template(
    turn=lambda role, content: F.concat(role, F.lit(": "), content, F.lit("\n")),
    opener="assistant: ",
    opener_after="user",
)
TEMPLATES = {"chatml": CHATML, "plain": PLAIN}


def as_template(template: Template | str) -> Template:
    if isinstance(template, Template):
        return template
    if template not in TEMPLATES:
        raise ValueError(f"unknown template {template!r}; known are {sorted(TEMPLATES)}")
    return TEMPLATES[template]
