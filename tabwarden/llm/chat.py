"""Chat formatting at the level of tokens.

Every turn is assembled from reserved ids and from segments that are encoded by
themselves: a mark for the role, the text, and the end of the turn. No content can
become a reserved id. Written out, reserved ids are strings; where those strings, or
the escape character, occur in content, a backslash goes before them, so the written
form can be parsed back exactly. Loss masks are runs of tokens; their places in the
conversation are prefix sums of the turns' lengths.

Turns are encoded one by one, on all executors. Only lengths are summed along a
conversation, so a long conversation is no large group.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

#: The template: marks of the usual roles, of any other role, and of a turn's end.
ROLE_MARKS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, OTHER_END, END = "### Role: ", " ###: ", " </turn>\n"
MARKS = [*ROLE_MARKS.values(), OTHER, OTHER_END, END]
#: Turns of these roles are learnt from.
LEARNT = ("assistant",)
ESCAPE = "\\"
_CONTROL = re.compile("|".join(re.escape(s) for s in [ESCAPE, *sorted({m.strip() for m in MARKS}, key=len, reverse=True)]))
_ESCAPED = re.compile(r"\\(.)", re.S)
#: Texts that are encoded at once, in characters.
BATCH = 500_000


def escape(text: str) -> str:
    """Put a backslash before each control string and each backslash."""
    return _CONTROL.sub(lambda m: ESCAPE + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Template:
    """Reserved ids above a vocabulary's, and its encoder."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text here
        first = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ids = {mark: first + k for k, mark in enumerate(MARKS)}
        self.marks = {i: mark for mark, i in self.ids.items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def turns(self, roles: list[str], texts: list[str]) -> Iterator[tuple[list[int], int, int]]:
        """Ids of each turn, and the run of them that the loss is taken on."""
        bodies = self.encode([escape(t) for t in texts])
        heads = self.encode([escape(r) if r not in ROLE_MARKS else "" for r in roles])
        for role, body, head in zip(roles, bodies, heads, strict=True):
            if role in ROLE_MARKS:
                lead = [self.ids[ROLE_MARKS[role]]]
            else:
                lead = [self.ids[OTHER], *head, self.ids[OTHER_END]]
            ids = [*lead, *body, self.ids[END]]
            yield (ids, len(lead), len(lead) + len(body)) if role in LEARNT else (ids, 0, 0)

    def decode(self, ids: Iterable[int]) -> str:
        """The written form of ids."""
        out, run = [], []
        for i in ids:
            if i in self.marks:
                out += [self.tokenizer.decode(run, skip_special_tokens=False)] if run else []
                out.append(self.marks[i])
                run = []
            else:
                run.append(int(i))
        out += [self.tokenizer.decode(run, skip_special_tokens=False)] if run else []
        return "".join(out)


_PARTS = re.compile(r"\\.|" + "|".join(re.escape(m) for m in MARKS), re.S)


def parse(written: str) -> list[tuple[str, str]]:
    """Roles and texts of written turns."""
    turns, role, start, names = [], None, 0, {m: r for r, m in ROLE_MARKS.items()}
    for found in _PARTS.finditer(written):
        mark = found.group()
        if mark in names:
            role, start = names[mark], found.end()
        elif mark == OTHER:
            role, start = None, found.end()
        elif mark == OTHER_END:
            role, start = unescape(written[start : found.start()]), found.end()
        elif mark == END:
            turns.append((role, unescape(written[start : found.start()])))
    return turns


@lru_cache(maxsize=2)
def template_of(path: str) -> Template:
    return Template(path)


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """One row for each turn, a conversation's in order: ``conv_id, place`` (from 0),
    ``ids``, the run of learnt tokens ``loss_from, loss_to``, and ``first_token``, the
    tokens of the conversation before it.

    Turns are ordered by ``turn`` (nulls first), role and text. Null roles and texts
    are empty. Rows with a null ``conv_id`` are one conversation. Repeated rows are
    turns of their own; other columns are ignored. An empty table gives an empty result.
    """
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = template_of(path)
        for batch in batches:
            ends = (batch["text"].str.len().cumsum() // BATCH).to_numpy()
            for part in np.unique(ends):
                rows = batch[ends == part]
                ids, begins, stops = zip(*template.turns(rows["role"].tolist(), rows["text"].tolist()), strict=True)
                yield rows.assign(ids=list(ids), loss_from=begins, loss_to=stops)

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids array<int>, loss_from int, loss_to int"
    turns = conversations.select("conv_id", "turn", text("role"), text("text")).mapInPandas(run, schema)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).alias("place"),
        "ids",
        "loss_from",
        "loss_to",
        F.coalesce(F.sum(F.size("ids").cast("long")).over(before), F.lit(0)).alias("first_token"),
    )


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """Digests of what formatted conversations say, read from their ids and masks:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens``.

    ``turns`` come from ``format_turns``. A task reads its sorted turns as a stream and
    holds one turn and the running digests, whatever a conversation's length.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        template = template_of(path)
        current: object = run  # no conversation is this
        state: list = []

        def done() -> tuple:
            n, said, chars, loss, written, tokens = state
            return (current, n, said.hexdigest(), chars, loss.hexdigest(), written, tokens)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        for batch in batches:
            out = []
            for conv, ids, begin, end, first in zip(*(batch[c] for c in ("conv_id", "ids", "loss_from", "loss_to", "first_token")), strict=True):
                conv = None if pd.isna(conv) else conv
                if conv != current or not state:
                    if state:
                        out.append(done())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if first != state[5]:
                    raise ValueError("turns are not in order")
                written = template.decode(ids)
                for role, text in parse(written):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learnt = unescape(template.decode(ids[begin:end]))
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(written)
                state[5] += len(ids)
            yield pd.DataFrame(out, columns=names).astype({"conv_id": object})
        if state:
            yield pd.DataFrame([done()], columns=names)

    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.select("conv_id", "ids", "loss_from", "loss_to", "first_token").mapInPandas(run, schema)
