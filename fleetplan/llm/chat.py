"""Chat formatting in windows of a token budget.

A turn is written as ``<|im_start|>role``, a line feed, its text, ``<|im_end|>`` and a line feed. A conversation is cut between turns into
windows: with the prefix sums of turn tokens, a window takes turns as long as they, the system turn and the repeated history fit
the budget. Each later window opens with the conversation's system turn and with the last turns before it, as many as two limits allow.
The loss mask of a window covers the texts of its new assistant turns; repeated ones are masked out, so each target is learned once.

Inside texts every ``<``, backslashes, ``|`` gets one backslash more before the bar, so no text holds ``<|`` and taking one away gives
the text back. Roles are escaped likewise, and their backslashes and line feeds too.

A conversation is worked through in its order as a stream of rows, and holds one window and its history at a time. A conversation of more than
``SEGMENT`` turns is dealt to several tasks in segments of so many turns; each gets the system turn and the history before it, and opens
a new window. No window crosses a segment, whatever task works on it.

Null or odd input: null texts and roles are empty; a null conversation id is an id; turns go by number (null first), equal ones by role and
text, and repeated rows are turns each; a turn is never cut: one that is larger than the budget is a window of its own, without history, and is marked. A system turn of more
than half the budget is not repeated; only a first turn can be the system turn. An empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetplan.llm.pretokens import ByteLevelEncoder, encoder
from fleetplan.llm.ranks import ranked
from fleetplan.llm.texts import short_batches
from fleetplan.session import stage

BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 2048, 512, 4
#: Turns of a conversation that one task formats.
SEGMENT = 4096

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_BARS, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
#: Characters of windows sent on at a time.
_OUT_CHARS = 1 << 20


def escape(text: str) -> str:
    return _BARS.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


@dataclass
class Turn:
    role: str
    text: str  # escaped
    tokens: int

    def written(self) -> str:
        return f"{OPEN}{self.role}\n{self.text}{CLOSE}\n"


@dataclass
class Window:
    first_turn: int
    repeated: list[Turn]
    new: list[Turn] = field(default_factory=list)

    def tokens(self) -> int:
        return sum(t.tokens for t in self.repeated) + sum(t.tokens for t in self.new)

    def row(self, conversation, budget: int, target: str) -> tuple:
        parts, mask, at = [], [], 0
        for i, turn in enumerate([*self.repeated, *self.new]):
            parts.append(turn.written())
            if i >= len(self.repeated) and turn.role == target:
                mask.append({"start": at + len(OPEN) + len(turn.role) + 1, "length": len(turn.text)})
            at += len(parts[-1])
        tokens = self.tokens()
        return conversation, self.first_turn, len(self.new), len(self.repeated), tokens, tokens > budget, "".join(parts), mask


class Windows:
    """The windows of one conversation's segment, turn by turn."""

    def __init__(self, budget: int, history_tokens: int, history_turns: int, at: int):
        self.budget, self.history_tokens = budget, history_tokens
        self.system: Turn | None = None
        self.recent: deque[Turn] = deque(maxlen=history_turns)
        self.at = at
        self.total = 0  # tokens of all turns so far
        self.begin = 0  # of those before the open window
        self.room = 0
        self.open: Window | None = None

    def known(self, turn: Turn, system: bool) -> None:
        """A turn before the segment."""
        if system:
            self.system = turn
        else:
            self.recent.append(turn)

    def add(self, turn: Turn, system: bool) -> Window | None:
        """Put a turn into the open window; where it does not fit, open another and return the full one."""
        done = None
        if self.open is None or self.total + turn.tokens - self.begin > self.room:
            done, self.open = self.open, self._opened(turn)
        self.open.new.append(turn)
        self.total += turn.tokens
        self.at += 1
        self.known(turn, system)
        return done

    def _opened(self, turn: Turn) -> Window:
        keep = [self.system] if self.system and 2 * self.system.tokens <= self.budget else []
        left = self.budget - sum(t.tokens for t in keep)
        history: deque[Turn] = deque()
        spare = min(self.history_tokens, left - turn.tokens)
        for old in reversed(self.recent):
            spare -= old.tokens
            if spare < 0:
                break
            history.appendleft(old)
        self.begin = self.total
        self.room = left - sum(t.tokens for t in history)
        return Window(self.at, [*keep, *history])


def format_conversations(
    turns: DataFrame,
    tokenizer: str,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    target: str = "assistant",
    segment: int = SEGMENT,
) -> DataFrame:
    """Windows of the conversations in ``turns`` (conv_id, turn, role, text).

    Columns: conv_id, first_turn (place of the first new turn in the conversation), n_new and n_repeated (turns; the repeated ones come
    first), n_tokens (texts by the tokenizer file, and the template's words), over_budget, text, and mask: spans of code points.
    """
    short_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = _dealt(rows, segment, history_turns)
    ordered = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "own", "turn", "role", "text")

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(ByteLevelEncoder, tokenizer)
        around: dict[str, int] = {}
        out, held, group, state = [], 0, None, None
        for batch in batches:
            conversations, segments, own, first, roles = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
            texts = [escape(t) for t in batch.column(6).to_pylist()]
            counts = [n for block in tool.encode(pa.array(texts, pa.string())) for n in block[2].tolist()]
            for conversation, part, new, is_first, role, text, n in zip(conversations, segments, own, first, roles, texts, counts):
                if (conversation, part) != group or state is None:
                    if state is not None and state.open:
                        out.append(state.open.row(group[0], budget, target))
                    group, state = (conversation, part), Windows(budget, history_tokens, history_turns, part * segment)
                name = escape_role(role)
                if name not in around:
                    if len(around) > 10_000:
                        around.clear()
                    around[name] = sum(map(len, tool.encode_texts([f"{OPEN}{name}\n", f"{CLOSE}\n"])))
                turn = Turn(name, text, n + around[name])
                system = role == "system" and (is_first or (new and part == 0 and state.at == 0))
                if not new:
                    state.known(turn, system)
                elif (done := state.add(turn, system)) is not None:
                    out.append(done.row(conversation, budget, target))
                    held += len(out[-1][6])
                    if held > _OUT_CHARS:
                        yield _batch(out)
                        out, held = [], 0
        if state is not None and state.open:
            out.append(state.open.row(group[0], budget, target))
        if out:
            yield _batch(out)

    schema = pa.schema(
        [
            ("conv_id", rows.limit(0).toArrow().schema.field("conv_id").type), ("first_turn", pa.int64()), ("n_new", pa.int32()), ("n_repeated", pa.int32()),
            ("n_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
        ]
    )

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*out), schema)], schema=schema)

    return ordered.mapInArrow(
        form, f"conv_id {kind}, first_turn bigint, n_new int, n_repeated int, n_tokens bigint, over_budget boolean, text string, mask array<struct<start:int,length:int>>"
    )


def _dealt(rows: DataFrame, segment: int, history_turns: int) -> DataFrame:
    """(conv_id, segment, own, first, turn, role, text): ``own`` is false for turns from before the segment, of which
    ``first`` marks the conversation's first one."""
    columns = ["conv_id", "segment", "own", "first", "turn", "role", "text"]
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > segment)
    large = stage(counts.withColumn("large", F.lit(True)).withColumnRenamed("conv_id", "large_id"), "long-conversations")
    whole = lambda df: df.select("conv_id", F.lit(0).cast("bigint").alias("segment"), F.lit(True).alias("own"), F.lit(False).alias("first"), "turn", "role", "text")
    if large.isEmpty():
        return whole(rows)
    same = F.col("conv_id").eqNullSafe(F.col("large_id"))
    small = whole(rows.join(large, same, "left_anti"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    placed = ranked(rows.join(large, same, "left_semi").withColumn("key", key), "key", ["turn", "role", "text"])
    at = F.floor(F.col("pos") / F.lit(segment)).cast("bigint")
    last = F.floor((F.col("n") - 1) / F.lit(segment)).cast("bigint")
    own = placed.withColumn("segment", at).withColumn("own", F.lit(True)).withColumn("first", F.lit(False))
    # the last turns of a segment also go to the next one, the first turn to all later ones
    tail = F.pmod(F.col("pos"), F.lit(segment)) >= segment - history_turns
    context = placed.where(tail & (at < last) & ((F.col("pos") > 0) | (F.col("role") != "system"))).withColumn("segment", at + 1)
    opening = placed.where((F.col("pos") == 0) & (F.col("role") == "system"))
    opening = opening.withColumn("segment", F.explode(F.sequence(F.lit(1).cast("bigint"), last)))
    before = context.withColumn("first", F.lit(False)).unionByName(opening.withColumn("first", F.lit(True)))
    return small.unionByName(own.select(columns)).unionByName(before.withColumn("own", F.lit(False)).select(columns))


def parsed(text: str, n_repeated: int, mask: list[dict]) -> list[tuple[str, str, str | None]]:
    """(role, text, text under the mask) of the new turns of a window."""
    spans = {m["start"]: m["length"] for m in mask}
    out = []
    for i, turn in enumerate(_TURN.finditer(text)):
        if i >= n_repeated:
            start = turn.start(2)
            target = unescape(text[start : start + spans[start]]) if start in spans else None
            out.append((unescape_role(turn[1]), unescape(turn[2]), target))
    return out


def read_turns(windows: DataFrame) -> DataFrame:
    """The turns (conv_id, place, role, text, target) of formatted windows, each once; ``target`` is null where no loss is taken."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (conversation, first, repeated, text, mask) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                found = parsed(text, repeated, mask)
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conversation] * n, batch.column(0).type), pa.array(range(first, first + n), pa.int64()), *[pa.array([x[k] for x in found], pa.string()) for k in range(3)]],
                    names=["conv_id", "place", "role", "text", "target"],
                )

    kind = windows.schema["conv_id"].dataType.simpleString()
    return windows.select("conv_id", "first_turn", "n_repeated", "text", "mask").mapInArrow(read, f"conv_id {kind}, place bigint, role string, text string, target string")


def conversation_digests(windows: DataFrame) -> DataFrame:
    """One row (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) for each conversation, read from its windows.

    A digest runs through a conversation in order, so one task takes it, as a stream that holds one window.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, state = [], None, None
        row = lambda: (group, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        typed = None
        for batch in batches:
            typed = batch.column(0).type
            for conversation, _, repeated, text, mask in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conversation != group:
                    if state is not None:
                        out.append(row())
                    group, state = conversation, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, target in parsed(text, repeated, mask):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    if target is not None:
                        state[2] += len(target)
                        state[3].update(target.encode())
                state[4] += len(text)
            if len(out) > 10_000:
                yield _digests(out, typed)
                out = []
        if state is not None:
            yield _digests([*out, row()], typed)

    def _digests(out: list[tuple], typed: pa.DataType) -> pa.RecordBatch:
        types = [typed, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    ordered = windows.select("conv_id", "first_turn", "n_repeated", "text", "mask").repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return ordered.mapInArrow(digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
