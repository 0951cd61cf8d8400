"""Chat formatting: budgeted, turn-aligned windows with a retained system turn, limited history and a loss mask."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .packing import token_ids

BUDGET, HISTORY = 2048, 512
OPEN, CLOSE = "<|turn|>", "<|end|>\n"

# Strings that a template of this or of another model family gives a meaning of its own.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, ("\\", *sorted(CONTROL, key=len, reverse=True)))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)


def escape(text: str) -> str:
    """No control string stands in the result; a backslash stands before what was taken apart, and before itself."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str, text: str) -> tuple[str, int]:
    """(formatted turn, where its text starts)."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    return head + escape(text) + CLOSE, len(head)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns of a window, in order: (role, text)."""
    at = 0
    while at < len(formatted):
        role = _ROLE.match(formatted, at + len(OPEN))
        end = formatted.index(CLOSE, role.end())
        yield unescape(role[1]), unescape(formatted[role.end() : end])
        at = end + len(CLOSE)


class Windows:
    """Windows of one conversation, turn by turn; no more is held than one window and its history."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, int, int] | None = None
        self.turns: list[tuple[str, int, int, bool]] = []  # formatted, start of text, tokens, whether a target
        self.sums = [0]  # prefix sums of the turns' tokens
        self.repeated = 0
        self.number = self.seen = 0

    def _room(self) -> int:
        return self.budget - (self.system[2] if self.system else 0)

    def add(self, role: str, text: str) -> Iterator[dict]:
        formatted, at = turn_text(role, text)
        tokens = len(token_ids(formatted)) - 1
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system = (formatted, at, tokens)
            return
        if len(self.turns) > self.repeated and self.sums[-1] + tokens > self._room():
            yield self._window()
            # the latest turns that fit the history's budget, and leave room for the next turn
            keep = bisect_left(self.sums, self.sums[-1] - max(0, min(self.history, self._room() - tokens)))
            self.turns = self.turns[keep:]
            self.sums = [s - self.sums[keep] for s in self.sums[keep:]]
            self.repeated = len(self.turns)
        self.turns.append((formatted, at, tokens, role == "assistant"))
        self.sums.append(self.sums[-1] + tokens)

    def _window(self) -> dict:
        parts = ([(*self.system, False)] if self.system else []) + self.turns
        old = self.repeated + (1 if self.system and self.number else 0)
        loss, place = [], 0
        new_from = len(parts) - (len(self.turns) - self.repeated)
        for k, (formatted, at, _, target) in enumerate(parts):
            if target and k >= new_from:
                loss.append({"start": place + at, "end": place + len(formatted) - len(CLOSE)})
            place += len(formatted)
        retained = [0] if self.system and self.number else []
        shift = 1 if self.system else 0
        repeats = retained + [shift + k for k in range(self.repeated)]
        assert len(repeats) == old
        self.number += 1
        tokens = self.sums[-1] + (self.system[2] if self.system else 0)
        return {"window": self.number - 1, "formatted": "".join(p[0] for p in parts), "loss": loss, "repeats": repeats, "tokens": tokens, "over_budget": tokens > self.budget}

    def end(self) -> Iterator[dict]:
        if len(self.turns) > self.repeated or self.system and not self.number:
            yield self._window()


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW = [("window", pa.int64()), ("formatted", pa.string()), ("loss", _LOSS), ("repeats", pa.list_(pa.int64())), ("tokens", pa.int64()), ("over_budget", pa.bool_())]
_WINDOW_SQL = "conv_id long, window long, formatted string, loss array<struct<start:long,end:long>>, repeats array<long>, tokens long, over_budget boolean"


def _format(budget: int, history: int):
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), *(pa.array([w[name] for _, w in rows], kind) for name, kind in _WINDOW)], ["conv_id", *(name for name, _ in _WINDOW)])

    def run(batches):
        now: object = run  # no conversation yet
        windows, rows, size = Windows(budget, history), [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                done = []
                if now is run or conv != now or conv is None:
                    done += [(now, w) for w in windows.end()]
                    now, windows = conv, Windows(budget, history)
                done += [(conv, w) for w in windows.add(role or "", text or "")]
                rows += done
                size += sum(len(w["formatted"]) for _, w in done)
                if size > 1 << 22:
                    yield out(rows)
                    rows, size = [], 0
        rows += [(now, w) for w in windows.end()]
        if rows:
            yield out(rows)

    return run


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss, repeats, tokens, over_budget; those of a conversation stand together, in order.

    A conversation's rows are taken by turn (null first; of equal turns by role, then text). Each turn
    is marked by its role and an end, with control strings inside role and text escaped reversibly. A
    window holds the conversation's system turn, if its first turn is one, then earlier turns repeated
    up to ``history`` tokens, then new turns up to ``budget`` tokens in all, as prefix sums of the
    turns' tokens allow; a turn that no window has room for gets one of its own, which is ``over_budget``,
    and so are all windows of a conversation whose system turn alone has more tokens. ``loss`` has the
    character spans of the new assistant texts: each is a target once, and repeated ones are masked.
    ``repeats`` numbers the window's turns that an earlier window has.

    Rows are dealt and sorted by conversation and streamed through each task, which holds one window
    at a time, so a conversation of any length fits. A null text or role is empty; each row with a null
    conv_id is a conversation of its own; repeated rows are turns of their own; an empty table gives no rows;
    other columns are ignored.
    """
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    ordered = given.repartition(F.coalesce("conv_id", F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format(budget, history), _WINDOW_SQL)


def _digests(batches):
    """Arrow function: windows, those of a conversation together and in order, to one row per conversation."""
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    state: list = []

    def close():
        if state:
            conv, n, turns, chars, loss, formatted = state
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for batch in batches:
        for conv, window, formatted, loss, repeats in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "window", "formatted", "loss", "repeats")), strict=True):
            if not window:
                close()
                state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            skip = set(repeats)
            for k, (role, text) in enumerate(read_turns(formatted)):
                if k not in skip:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["end"]])
                state[3] += len(text)
                state[4].update(text.encode())
            state[5] += len(formatted)
        if len(rows) > 5000:
            yield out()
            rows.clear()
    close()
    if rows:
        yield out()


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    windows = format_conversations(rows.unionByName(extra))
    return windows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
