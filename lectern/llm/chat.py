"""Chat formatting: every assistant turn becomes an example of its own, after all turns before it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches

#: Strings that common templates treat as control; none of them may stand in a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: Marks of this template: a turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "</s>"

# a control string, with any number of backslashes after its first character
_ANY = re.compile("|".join(f"({re.escape(c[0])})(\\\\*)({re.escape(c[1:])})" for c in sorted(CONTROL, key=len, reverse=True)))


def _may_hold(text: str) -> bool:
    """Whether a text has a character that a control string begins with."""
    return "<" in text or "[" in text


def escape(text: str) -> str:
    """The text with one more backslash inside each control string, escaped ones too: no control string is left."""
    if not _may_hold(text):
        return text
    return _ANY.sub(lambda m: "{}\\{}{}".format(*[g for g in m.groups() if g is not None]), text)


def unescape(text: str) -> str:
    """The inverse of escape()."""

    def less(m):
        first, bars, rest = [g for g in m.groups() if g is not None]
        return first + bars[1:] + rest if bars else m.group()

    return _ANY.sub(less, text) if _may_hold(text) else text


def mark(role: str, text: str) -> tuple[str, str, str]:
    """A turn's opening, its escaped text and its end."""
    return OPEN + escape(role) + MIDDLE, escape(text), CLOSE


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of formatted text, unescaped: no mark stands inside a role or a text."""
    turns = [part.partition(MIDDLE) for part in formatted.split(CLOSE)[:-1]]
    return [(unescape(head[len(OPEN) :]), unescape(body)) for head, _, body in turns]


def examples(turns: Iterator[tuple[str, str]], trained: str = "assistant") -> Iterator[tuple[int, str, int, int]]:
    """(turn number, formatted text, start, end) for each trained turn: the text of [start, end) is its reply.

    The formatted text holds all turns before it as context, then the turn. Turns after the last
    trained one, or all turns where none is trained, make one last example with an empty mask.
    """
    so_far, number, rest = [], 0, False
    size = 0
    for number, (role, text) in enumerate(turns):
        before, body, after = mark(role, text)
        so_far += [before, body, after]
        start, size = size + len(before), size + len(before) + len(body) + len(after)
        rest = role != trained
        if not rest:
            yield number, "".join(so_far), start, start + len(body)
            so_far = ["".join(so_far)] if len(so_far) > 64 else so_far
    if rest:
        yield number, "".join(so_far), size, size


def expand(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """(conv_id, example, turn_no, formatted, loss_start, loss_end): one row for each trained turn, see examples().

    loss_start and loss_end are code points of formatted; the reply between them alone is trained.
    Turns are taken in the order of turn (null first), role, text; null roles and texts are empty;
    rows of a null conv_id are one conversation; repeated rows are turns of their own. A
    conversation's turns come sorted to one task, which streams them: it holds one
    example at a time, never the conversation's examples together. An empty table gives no rows.
    """
    small_batches(turns.sparkSession)
    work = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    dealt = work.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rest = StructType.fromDDL("example int, turn_no int, formatted string, loss_start long, loss_end long")
    schema = StructType([work.schema["conv_id"], *rest.fields])
    kind = pa.schema([("example", pa.int32()), ("turn_no", pa.int32()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def conversations(batches):
        """(conv_id, iterator of its turns), one after another."""
        rows = ((b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()) for b in batches for i in range(b.num_rows))
        ahead = next(rows, None)

        def own(of):
            nonlocal ahead
            while ahead is not None and ahead[0] == of:
                yield ahead[1], ahead[2]
                ahead = next(rows, None)

        while ahead is not None:
            now = ahead[0]
            got = own(now)
            yield now, got
            for _ in got:
                pass

    def run(batches):
        out, size, first = [], 0, None

        def batch():
            columns = [pa.array([r[0] for r in out], first), *(pa.array([r[i] for r in out], kind.field(i - 1).type) for i in range(1, 6))]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", *kind.names])

        def typed():
            nonlocal first
            for b in batches:
                first = b.schema.field(0).type
                yield b

        for cid, own in conversations(typed()):
            for n, (number, formatted, start, end) in enumerate(examples(own, trained)):
                out.append((cid, n, number, formatted, start, end))
                size += len(formatted)
                if size > 4_000_000 or len(out) >= 1024:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)
