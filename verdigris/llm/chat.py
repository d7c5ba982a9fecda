"""Chat formatting with a grammar round trip.

A template's grammar is ``turn = OPEN role MIDDLE text CLOSE``, and a conversation is its turns one after the other. Control strings are those
three and any that the template wants kept out of texts. In a role or text, a control string with k escape marks after its first character stands for one
with k - 1; without a mark it is control. Escaping adds one mark to each, so that it can be undone whatever marks a text holds itself.

Every piece of a conversation is rendered as it is, and parsed again by a deterministic parser. Turns that do not come back as they were, or
that are lost because control strings of theirs derail the parser, are escaped and the piece is rendered and parsed anew, until the turns are
identical. Texts without control strings stay as they are.

Rows are dealt by ranges of conversation and turn, and within a turn of role and text, so that a conversation with a third of all rows is formatted by many tasks. A task renders
its rows in order into pieces of at most ``PIECE`` characters and ``TURNS`` turns, a longer turn being a piece of its own. A conversation is its pieces in
order: grammar and mask know no context beyond a turn. A piece marks with ``whole`` that it holds its conversation from beginning to end; digests of those need
no shuffle, and others stream in order through one task each, piece by piece.

A null text or role is the empty one. Rows of a conversation are ordered by turn (null first), those with one turn by the
beginning of role and text, then by a hash; repeated rows are turns each. Rows without conv_id are one conversation, whose id is null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import materialize, read

PIECE, TURNS = 1 << 18, 256
MARK = "␛"
ROWS = "conv_id long, turn long, role string, text string"
PIECES = "conv_id long, part long, piece long, whole boolean, n_turns long, formatted string, loss array<struct<begin:int,end:int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass(frozen=True)
class Template:
    """open, middle and close of a turn; reserved are further control strings; roles in learnt are under the loss mask.

    No control string may hold another one's first character but at its own beginning, so that none begins inside another."""

    open: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    close: str = "<|im_end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    learnt: tuple[str, ...] = ("assistant",)
    mark: str = MARK
    control: re.Pattern = field(init=False, compare=False, repr=False)
    marked: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        words = (self.open, self.middle, self.close, *self.reserved)
        first = {w[:1] for w in words}
        if not all(len(w) > 1 and not first & set(w[1:]) and self.mark not in w for w in words) or len({*words[:3]}) < 3 or len(self.mark) != 1:
            raise ValueError("control strings must be different, have two characters or more, and hold first characters at their beginning only")
        longest = sorted(set(words), key=len, reverse=True)
        object.__setattr__(self, "control", re.compile("|".join(map(re.escape, longest))))
        m = re.escape(self.mark)
        object.__setattr__(self, "marked", re.compile("|".join(f"{re.escape(w[0])}{m}*{re.escape(w[1:])}" for w in longest)))

    def escape(self, text: str) -> str:
        return self.marked.sub(lambda x: x[0][0] + self.mark + x[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.marked.sub(lambda x: x[0][0] + x[0][2:] if x[0][1] == self.mark else x[0], text) if self.mark in text else text

    def render(self, role: str, text: str) -> str:
        return f"{self.open}{role}{self.middle}{text}{self.close}"

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """(role, text, begin, end) of every turn that the grammar finds from the beginning, up to the first control string that is out of
        place; begin and end are where the text stands in formatted, in code points."""
        out, wanted, at, role, begin = [], self.open, 0, "", 0
        for c in self.control.finditer(formatted):
            if c[0] != wanted or (wanted == self.open and c.start() != at):
                return out
            if wanted == self.open:
                wanted = self.middle
            elif wanted == self.middle:
                role, begin, wanted = formatted[at : c.start()], c.end(), self.close
            else:
                out.append((self.unescape(role), self.unescape(formatted[begin : c.start()]), begin, c.start()))
                wanted = self.open
            at = c.end()
        return out

    def ends_well(self, formatted: str) -> bool:
        """Whether formatted is nothing but turns."""
        turns = self.parse(formatted)
        return (turns[-1][3] + len(self.close) if turns else 0) == len(formatted)

    def format(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str, int, int]]]:
        """The formatted turns and what the parser makes of them, which are the turns again."""
        written = list(turns)
        while True:
            formatted = "".join(self.render(*t) for t in written)
            back = self.parse(formatted)
            if [b[:2] for b in back] == turns:
                return formatted, back
            kept = next((i for i, (b, t) in enumerate(zip(back, turns, strict=False)) if b[:2] != t), min(len(back), len(turns)))
            # the first turn that did not come back is at fault, or the one before it swallowed it
            conflicts = [i for i in range(max(0, kept - 1), len(turns)) if (self.escape(turns[i][0]), self.escape(turns[i][1])) != turns[i] and written[i] == turns[i]]
            if not conflicts:
                raise ValueError("the template cannot express these turns")
            for i in conflicts:
                written[i] = (self.escape(turns[i][0]), self.escape(turns[i][1]))


def pieces(rows: Iterator[tuple[int | None, str, str]], template: Template) -> Iterator[tuple]:
    """(conv_id, first, last, turns, formatted, loss) of (conv_id, role, text) in order; first and last say whether the
    task's rows of the conversation begin or end with the piece."""
    held, size, owner, first, some = [], 0, None, True, False

    def flush(last: bool) -> tuple:
        formatted, back = template.format(held)
        return owner, first, last, len(held), formatted, [{"begin": b, "end": e} for role, _, b, e in back if role in template.learnt]

    for conv, role, text in rows:
        new = some and conv != owner
        if held and (new or size + len(text) > PIECE or len(held) == TURNS):
            yield flush(new)
            held, size, first = [], 0, new
        owner, some = conv, True
        held.append((role, text))
        size += len(text)
    if held:
        yield flush(True)


def format_conversations(rows: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The formatted conversations as PIECES, by part and piece; loss has the spans of each learnt text in formatted, escapes included."""
    template = template or Template()
    own = rows.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # bounded sort keys: what a range's borders are made of goes to the driver
    order = ["conv_id", "turn", F.left("role", F.lit(32)), F.left("text", F.lit(32)), F.xxhash64("role", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
        names = [c.split()[0] for c in PIECES.split(", ")]
        each = pieces((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)), template)
        out, size, ahead = [], 0, next(each, None)
        while ahead is not None:
            (conv, first, last, n, formatted, loss), ahead = ahead, next(each, None)
            # a task's first and last conversation may go on in its neighbours
            whole = first and last and seen > 0 and ahead is not None
            out.append((conv, part, seen, whole, n, formatted, loss))
            seen, size = seen + 1, size + len(formatted)
            if size > 4 * PIECE or ahead is None:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, size = [], 0

    return own.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, PIECES)


class Reader:
    """Digests of one conversation, read back from its pieces in order."""

    def __init__(self, template: Template):
        self.template, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def read(self, formatted: str, loss: list[dict]) -> Reader:
        if not self.template.ends_well(formatted):
            raise ValueError("a piece is not made of turns")
        for role, text, _, _ in self.template.parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        for span in loss:
            text = self.template.unescape(formatted[span["begin"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        return self

    def row(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """DIGEST of every conversation, from the PIECES as they are stored."""
    template = template or Template()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [Reader(template).read(f, loss).row(conv) for conv, f, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True)]
            if rows:
                yield batch(rows)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, reader = None, None
        for b in batches:
            done = []
            for conv, f, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if reader is None or conv != owner:
                    done += [reader.row(owner)] if reader else []
                    owner, reader = conv, Reader(template)
                reader.read(f, loss)
            if done:
                yield batch(done)
        if reader:
            yield batch([reader.row(owner)])

    whole = formatted.where("whole").select("conv_id", "formatted", "loss").mapInArrow(alone, DIGEST)
    cut = formatted.where("not whole").select("conv_id", "part", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(streamed, DIGEST)
    return whole.unionByName(cut)


#: The conversation that op13 adds: its texts are control strings of a widespread template.
PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the stored pieces."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(materialize(format_conversations(rows.unionByName(probe)), "formatted"))
