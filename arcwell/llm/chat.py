"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text.  To find where each turn stands in
the output, successive prefixes of the conversation are rendered and consecutive
outputs compared: what the longer one adds is the new turn's span.  If it does not
begin with the shorter one, the template rewrites history; the first position that
changed is reported, and the span runs from there.

Rendering all prefixes of n turns costs n squared, and a black box needs it: it may
rewrite any turn when any later one comes.  Only for a template that declares that a
turn's piece depends on that turn alone (its attribute `turn_local` is true, as that
of marked) the prefix is cut back after `window` turns to the last `overlap` ones, as
if the conversation began there.  One that doesn't keep its word at a cut (checked on
the first turn behind it) is rendered in whole prefixes from there.

Turns are dealt by conversation and sorted in the partition; a task streams them in
order and holds the window and running digests, so under a turn-local template a
conversation of any length needs little memory; under others a task holds one whole
conversation at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
_ESCAPED = re.compile(r"[<\[\\]")
_UNESCAPE = re.compile(r"[<\[\\]\\")
_PARSE = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash behind each `<`, `[` and backslash: no control string, ours or another's of the forms <...> and [...], is left whole."""
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


def marked(turns: Sequence[Turn]) -> str:
    """The default template: role and text between control strings, a line each."""
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}\n" for role, text in turns)


marked.turn_local = True


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn that marked() wrote; start and end enclose the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _PARSE.finditer(formatted)]


@dataclass(frozen=True)
class Span:
    """Where a turn was added to the output of the prefix that ends with it.

    start counts from the beginning of the conversation's output; rewritten is the
    first position at which the turn changed what was there before, or None.
    """

    start: int
    text: str
    rewritten: int | None = None


def _common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Incremental:
    """Spans of turns that arrive one by one, from renderings of their prefixes."""

    def __init__(self, template: Template = marked, window: int = 16, overlap: int = 2):
        self.template, self.window, self.overlap = template, window, overlap
        self.turns: list[Turn] = []
        self.last = template([])
        self.cut, self.local = 0, getattr(template, "turn_local", False)

    def add(self, turn: Turn) -> Span:
        self.turns.append(turn)
        now = self.template(self.turns)
        if now.startswith(self.last):
            found = Span(self.cut + len(self.last), now[len(self.last) :])
        else:
            at = _common(now, self.last)
            found = Span(self.cut + at, now[at:], self.cut + at)
            self.local = False
        self.last = now
        if self.local and len(self.turns) > self.window:
            short = self.turns[-self.overlap :]
            before, after = self.template(short[:-1]), self.template(short)
            if after.startswith(before) and after[len(before) :] == found.text:
                self.cut += len(now) - len(after)
                self.turns, self.last = short, after
            else:
                self.local = False
        return found


def locate(turns: Sequence[Turn], template: Template = marked) -> tuple[str, list[Span]]:
    """The whole output and each turn's span."""
    rendering = Incremental(template, window=len(turns) + 1)
    spans = [rendering.add(t) for t in turns]
    return rendering.last, spans


def rewrites_history(turns: Sequence[Turn], template: Template) -> bool:
    return any(s.rewritten is not None for s in locate(turns, template)[1])


class _Digest:
    """One conversation's digests, fed span by span with what is read back from each."""

    def __init__(self):
        self.rendering = Incremental()
        self.all, self.loss = sha256(), sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, role: str, text: str) -> None:
        span = self.rendering.add((role, text))
        if span.rewritten is not None or span.start != self.chars:
            raise ValueError("the template rewrites history")
        self.chars += len(span.text)
        for role, text, _, _ in parse(span.text):
            self.n += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Turns dealt by conversation and in order; null texts and roles are empty, ties go by role and text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: Template = marked, trained: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, start, formatted, rewritten, trained) of each turn: its piece of the output and whether the loss covers it.

    Under a template that rewrites history, starts refer to the output of the
    prefix that ends with the turn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rendering = object(), None
        for rows in batches:
            out = []
            for conv, turn, role, text in zip(rows["conv_id"], rows["turn"], rows["role"], rows["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if rendering is None or conv != now:
                    now, rendering = conv, Incremental(template)
                span = rendering.add((role, text))
                out.append((conv, None if pd.isna(turn) else int(turn), role, span.start, span.text, span.rewritten, role == trained))
            yield pd.DataFrame(out, columns=["conv_id", "turn", "role", "start", "formatted", "rewritten", "trained"]).astype({"conv_id": "Int64", "turn": "Int64", "rewritten": "Int64"})

    return sorted_turns(conversations).mapInPandas(run, "conv_id long, turn long, role string, start long, formatted string, rewritten long, trained boolean")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted turns.

    Rows without conv_id make one conversation whose id is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest, done = None, None, []
        for rows in batches:
            for conv, role, text in zip(rows["conv_id"], rows["role"], rows["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if digest is None or conv != now:
                    if digest is not None:
                        done.append(digest.row(now))
                    now, digest = conv, _Digest()
                digest.add(role, text)
            yield _frame(done)
            done = []
        if digest is not None:
            yield _frame([digest.row(now)])

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return sorted_turns(conversations).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two texts imitate another template's control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = rows.sparkSession.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(more)
