"""Chat formatting by columnar byte assembly.

A turn becomes

    <turn>ROLE\\n TEXT</turn>\\n

with control strings escaped within role and text, and a conversation is its turns one after the other. A batch of
turns is laid out at once: numpy finds the bytes to escape, adds up segment lengths into offsets, and scatters headers,
contents and footers into one preallocated buffer, which becomes an Arrow column as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Bytes that are laid out or read back at once.
PIECE = 1 << 20
OPEN, AFTER_ROLE, CLOSE = b"<turn>", b"\n", b"</turn>\n"
#: What begins a control string within a role or text, or escapes one, and what stands for it.
ESCAPES = ((b"\\", b"\\\\"), (b"<turn>", b"\\lturn>"), (b"</turn>", b"\\l/turn>"))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings and its n + 1 offsets; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)), offs - offs[0]


class Part:
    """Escaped contents of a column: its source bytes, and the length of each row. Bytes are worked on PIECE at a time."""

    def __init__(self, col: pa.Array, newline: bool = False, piece: int = PIECE):
        self.data, self.offs = _flat(col)
        self.newline, self.piece = newline, piece
        before, total = np.zeros(len(self.offs), np.int64), 0  # bytes to escape before each row begins, and in all
        for x, hit in self._hits():
            sums = np.concatenate([[0], np.cumsum(hit)])
            rows = slice(np.searchsorted(self.offs, x, "right"), np.searchsorted(self.offs, x + len(hit), "right"))
            before[rows] = total + sums[self.offs[rows] - x]
            total += int(sums[-1])
        self.lens = np.diff(self.offs) + np.diff(before)
        self.before = before[:-1]

    def _hits(self) -> Iterator[tuple[int, np.ndarray]]:
        """Piece by piece, where it begins and which bytes are escaped by a second one: backslashes, each < that begins a control string of
        its own row, and line feeds where newline is set."""
        data, ends = self.data, self.offs[1:]
        for x in range(0, len(data), self.piece):
            own = data[x : x + self.piece]
            hit = own == 0x5C
            if self.newline:
                hit |= own == 0x0A
            opens = np.flatnonzero(own == 0x3C) + x
            for control in (b"turn>", b"/turn>"):
                at = opens
                if len(at):
                    at = at[ends[np.searchsorted(ends, at, "right")] - at > len(control)]
                for k, c in enumerate(control, 1):
                    at = at[data[at + k] == c]
                hit[at - x] = True
            yield x, hit

    def scatter(self, out: np.ndarray, starts: np.ndarray) -> None:
        """Put row k's escaped bytes into out from starts[k] on."""
        total = 0
        for x, hit in self._hits():
            own = self.data[x : x + len(hit)]
            place = np.arange(x, x + len(hit))
            row = np.searchsorted(self.offs, place, "right") - 1
            place += (starts - self.offs[:-1] - self.before)[row]  # where it goes but for the escapes of its row so far
            escapes = np.cumsum(hit)
            place += escapes
            place += total
            out[place] = np.where(hit & (own == 0x3C), np.uint8(0x6C), np.where(hit & (own == 0x0A), np.uint8(0x6E), own))
            out[place[hit] - 1] = 0x5C
            total += int(escapes[-1])


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One formatted segment (string) for each turn, and where its text begins and ends in the segment's bytes."""
    n = len(texts)
    role, text = Part(roles, newline=True), Part(texts)
    pieces = [(OPEN, None), (None, role), (AFTER_ROLE, None), (None, text), (CLOSE, None)]
    lengths = np.stack([np.full(n, len(fixed)) if part is None else part.lens for fixed, part in pieces])
    offsets = np.concatenate([[0], np.cumsum(lengths.sum(0))])
    within = np.cumsum(lengths, 0) - lengths
    out = np.empty(int(offsets[-1]), np.uint8)
    for (fixed, part), w in zip(pieces, within, strict=True):
        starts = offsets[:-1] + w
        if part is None:
            out[starts[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
        else:
            part.scatter(out, starts)
    segments = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)])
    return segments, within[3], within[4]


def unescape(x: bytes) -> bytes:
    """The text that was escaped."""
    if b"\\" not in x:
        return x
    return b"\\".join(p.replace(b"\\l", b"<").replace(b"\\n", b"\n") for p in x.split(b"\\\\"))


def unescaped(x: memoryview, piece: int = PIECE) -> Iterator[bytes]:
    """The text that was escaped, piece by piece; no piece ends within an escape."""
    at = 0
    while at < len(x):
        end = min(len(x), at + piece)
        run = end
        while run > at and x[run - 1] == 0x5C:
            run -= 1
        end = min(len(x), end + (end - run) % 2)
        yield unescape(bytes(x[at:end]))
        at = end


def code_points(x: bytes | memoryview, piece: int = PIECE) -> int:
    """Code points of UTF-8 bytes."""
    data = np.frombuffer(x, np.uint8)
    return sum(int(np.count_nonzero((data[k : k + piece] & 0xC0) != 0x80)) for k in range(0, len(data), piece))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, segment (the turn as formatted), text_begin, text_end (its text's bytes), loss (learned from).

    Every turn is laid out for itself, so one long conversation is spread over many tasks; a conversation is its
    segments in order of turn. Null roles and texts count as empty. Only the assistant's texts are under the loss mask. A
    long text is laid out in pieces: beside itself and its segment it takes bounded memory. Repeated rows and turn numbers
    are turns of their own. Other columns of turns, whatever their names, play no part; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            conv, turn, role, text = (b.column(k) for k in range(4))
            segments, begin, end = assemble(role, text)
            loss = pa.array([r == "assistant" for r in role.to_pylist()])
            yield pa.RecordBatch.from_arrays([conv, turn, role, segments.cast(pa.string()), pa.array(begin), pa.array(end), loss], ["conv_id", "turn", "role", "segment", "text_begin", "text_end", "loss"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, segment string, text_begin long, text_end long, loss boolean")


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from its segments alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of one turn number go by role, then segment. A hash over a conversation needs its turns in order: they are
    sorted within a partition and streamed through the hash's state, so a long conversation takes time but no memory.
    """
    ordered = formatted.select("conv_id", "turn", "role", "segment", "text_begin", "text_end", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> pa.RecordBatch:
            n, turns, chars, loss, formatted_chars = state
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([now[0]], pa.int64()), "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [formatted_chars]})

        for b in batches:
            segments = b.column(b.schema.get_field_index("segment"))
            for k, (conv, begin, end, loss) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "text_begin", "text_end", "loss")), strict=True)):
                if now is None or now[0] != conv:
                    if now is not None:
                        yield row()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = memoryview(segments[k].as_buffer())
                state[0] += 1
                for piece in unescaped(raw[len(OPEN) : begin - len(AFTER_ROLE)]):
                    state[1].update(piece)
                state[1].update(b"\n")
                for piece in unescaped(raw[begin:end]):
                    state[1].update(piece)
                    if loss:
                        state[2] += code_points(piece)
                        state[3].update(piece)
                state[1].update(b"\n")
                state[4] += code_points(raw)
        if now is not None:
            yield row()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
