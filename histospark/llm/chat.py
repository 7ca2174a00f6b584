"""Chat formatting: a finite-state machine over roles, and a declarative template with loss flags.

A conversation becomes one string of segments. A turn is the opening mark and its role's label, the
escaped text and the closing mark; only the texts of the template's loss roles are under the loss.
Inside texts and labels, a backslash goes before every control string and every backslash, so the
output can be parsed back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What marks turns, how roles are labelled, which roles' texts are learned, and which turn may follow which."""

    opens: str = "### "
    label_ends: str = ": "
    closes: str = "</turn>"
    between: str = "\n"
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    #: Goes before the escaped role itself, for roles without a label.
    other: str = "@"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "begin"
    moves: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "briefed"),
        ("begin", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )
    accepts: tuple[str, ...] = ("answered",)


DEFAULT = Template()


@dataclass
class Formatter:
    template: Template
    in_text: re.Pattern = field(init=False)
    in_label: re.Pattern = field(init=False)
    turn: re.Pattern = field(init=False)

    def __post_init__(self):
        t = self.template
        control = [re.escape("\\"), re.escape(t.opens.strip() or t.opens), re.escape(t.closes)]
        self.in_text = re.compile("|".join(control))
        self.in_label = re.compile("|".join([*control, re.escape(t.label_ends.strip() or t.label_ends)]))
        # all up to an end mark that no backslash precedes
        inner = lambda end: rf"((?:[^\\{re.escape(end[0])}]++|\\.|{re.escape(end[0])}(?!{re.escape(end[1:])}))*+)" if len(end) > 1 else rf"((?:[^\\{re.escape(end)}]++|\\.)*+)"
        self.turn = re.compile(re.escape(t.opens) + inner(t.label_ends) + re.escape(t.label_ends) + inner(t.closes) + re.escape(t.closes), re.DOTALL)
        self.labels = dict(t.labels)
        self.roles = {v: k for k, v in t.labels}
        self.next = {(a, role): b for a, role, b in t.moves}

    def escape(self, text: str, control: re.Pattern | None = None) -> str:
        return (control or self.in_text).sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def valid(self, roles: list[str]) -> bool:
        """Whether the machine accepts the order of roles."""
        state = self.template.start
        for role in roles:
            state = self.next.get((state, role))
            if state is None:
                return False
        return state in self.template.accepts

    def segments(self, turns: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """Pieces of output with their loss flags."""
        t, out = self.template, []
        for k, (role, text) in enumerate(turns):
            label = self.labels.get(role)
            label = t.other + self.escape(role, self.in_label) if label is None else label
            out += [((t.between if k else "") + t.opens + label + t.label_ends, False), (self.escape(text), role in t.loss_roles), (t.closes, False)]
        return out

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted conversation."""
        turns, at = [], 0
        while at < len(formatted):
            if turns:
                assert formatted.startswith(self.template.between, at), "no mark between turns"
                at += len(self.template.between)
            m = self.turn.match(formatted, at)
            assert m, "no turn where one should begin"
            role = self.roles.get(m[1])
            turns.append((self.unescape(m[1][len(self.template.other) :]) if role is None else role, self.unescape(m[2])))
            at = m.end()
        return turns


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, valid, formatted, loss_spans (array of starts and ends in code points, under the loss).

    Rows are gathered by conv_id and ordered by turn, then role and text, nulls first; a null role or
    text is empty. Every conversation is formatted, and ``valid`` tells whether the machine accepts
    its roles. Rows with a null conv_id are one conversation. A conversation is one output string,
    so it has to fit into a task; conversations are dealt by their id.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        formatter = Formatter(template)
        for batch in batches:
            out = []
            for turns in batch["turns"]:
                turns = [(t["role"], t["text"]) for t in turns]
                parts, spans, at = formatter.segments(turns), [], 0
                for text, loss in parts:
                    if loss:
                        spans.append({"start": at, "end": at + len(text)})
                    at += len(text)
                out.append((formatter.valid([r for r, _ in turns]), "".join(p for p, _ in parts), spans))
            yield pd.DataFrame({"conv_id": batch["conv_id"], "valid": [o[0] for o in out], "formatted": [o[1] for o in out], "loss_spans": [o[2] for o in out]}, dtype=object)

    kind = conversations.schema["conv_id"].dataType.simpleString()
    return gathered.mapInPandas(write, f"conv_id {kind}, valid boolean, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, valid, turns (role, text), loss_text (what the spans cover, unescaped), formatted_chars: parsed from the output alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        formatter = Formatter(template)
        for batch in batches:
            turns = [[{"role": r, "text": t} for r, t in formatter.parse(f)] for f in batch["formatted"]]
            loss = ["".join(formatter.unescape(f[s["start"] : s["end"]]) for s in spans) for f, spans in zip(batch["formatted"], batch["loss_spans"], strict=True)]
            yield pd.DataFrame({"conv_id": batch["conv_id"], "valid": batch["valid"], "turns": turns, "loss_text": loss, "formatted_chars": [len(f) for f in batch["formatted"]]}, dtype=object)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInPandas(read, f"conv_id {kind}, valid boolean, turns array<struct<role:string,text:string>>, loss_text string, formatted_chars long")
