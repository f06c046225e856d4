"""Packing of tokenised documents into training sequences by sum-of-squares online placement.

Each input partition is packed on its own, in one pass and without a shuffle. A document's full windows become sequences
at once; what is left of it (shorter than a window) is placed online: of all fill levels at which it fits, and a new
window, it takes the one after which the sum of squared counts of partially filled windows is least. The counts are kept
in an array indexed by fill level. A level is GRAIN ids wide, so that windows fill up with few documents too: a window
that lacks fewer than GRAIN ids is full, and the first ids of a spare document, which is set aside for that, complete it.
Placements are never undone while a window is open. At the end of a partition, or when MAX_OPEN windows are open, the
fullest windows stay as placed and are completed with the pieces of the least full ones, cut where they end; the rest, of
fewer ids than a window, becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import ship

#: Windows that may be open at a time in a task: with 2048 ids of 4 bytes each, 16 MB.
MAX_OPEN = 2048
#: Ids in a fill level. The open windows left at the end of a task are about as many as levels, so wide levels leave few.
GRAIN = 128
#: Texts whose ids a worker remembers; a memory bound only, results don't depend on it.
MEMO = 200_000
#: The added token of byte_bpe_50k, which its tokenizer finds in texts also without add_special_tokens.
SPECIAL = (("<|endoftext|>", 50256),)
_SCHEMA = "{id} {type}, start long, length long, ids_le binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


class _Memo(dict):
    """Ids (as little-endian bytes) of a space and a chunk without spaces."""

    def __init__(self, core):
        super().__init__()
        self.core = core

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():  # one piece of the pattern
            found = array("I", self.core.encode_single_piece((" " + chunk).encode())).tobytes()
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # two pieces
            found = self[chunk[:-1]] + array("I", self.core.encode_single_piece(chunk[-1].encode())).tobytes()
        else:
            found = array("I", self.core.encode_ordinary(" " + chunk)).tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = found
        return found


#: A single space between characters that aren't white space always begins a piece of the tokenizer's pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Spaces next to other white space need the pattern above; so, to be safe, do texts with rare kinds of white space.
_ODD = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class ByteBpe:
    """Ids of a byte-level BPE. Texts are cut where the pre-tokenizer always cuts, and the ids of frequent chunks are remembered."""

    def __init__(self, ranks_path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        self._special = dict(special)
        longest = sorted(filter(None, self._special), key=len, reverse=True)
        self._specials = re.compile("|".join(map(re.escape, longest))) if longest else None

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._memo = _Memo(self._core)

    def forget(self) -> None:
        """Give up the remembered ids: workers outlive their tasks, and other tasks need the memory."""
        self._memo.clear()

    def ids(self, text: str) -> np.ndarray:
        if not any(x in text for x in self._special):
            return self._ordinary(text)
        found, at = [], 0
        for m in self._specials.finditer(text):
            found += [self._ordinary(text[at : m.start()]), np.array([self._special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*found, self._ordinary(text[at:])])

    def _ordinary(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        odd = text[0] == " " or text[-1] == " " or any(x in text for x in _ODD) or _RARE.search(text)
        chunks = _CUT.split(text) if odd else text.split(" ")
        first = array("I", self._core.encode_ordinary(chunks[0])).tobytes()
        return np.frombuffer(first + b"".join(map(self._memo.__getitem__, chunks[1:])), np.uint32)


@functools.lru_cache(2)
def tokenizer(ranks_path: str | None, special: tuple[tuple[str, int], ...] = SPECIAL) -> ByteBpe:
    """ranks_path: a file of base64 byte strings and ranks; None: the public vocabulary byte_bpe_50k. special: strings and their ids."""
    import public_tokenizers

    return ByteBpe(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


class SumOfSquares:
    """Packs pieces (key, document length, start, ids) into windows; yields (pieces of a sequence, its padded length).

    Level k has the open windows that hold more than (k - 1) * grain and at most k * grain ids; level 0 stands for a new
    window. ``kept`` and ``moved`` count the ids of shared sequences that stayed where they were placed, and those that
    completed windows or were left at the end.
    """

    def __init__(self, capacity: int, max_open: int = MAX_OPEN, grain: int = 1):
        self.capacity, self.max_open, self.grain = capacity, max_open, grain
        self.level = np.zeros(-(-capacity // grain) + 1, np.int64)
        self.at: list[deque] = [deque() for _ in self.level]  # windows (fill, pieces), the first placed first
        self.open = self.kept = self.moved = 0
        self.waiting: list[tuple[int, list]] = []  # windows that lack a few ids
        self.spare: tuple | None = None

    def full(self, fill: int) -> bool:
        return self.capacity - fill < self.grain

    def place(self, size: int) -> int:
        """The fill level (0: a new window) to which a piece of ``size`` goes; of equal ones the fullest."""
        c, g, n = self.capacity, self.grain, self.level.tolist()
        best, gain = 0, 0 if self.full(size) else 2 * n[-(-size // g)] + 1
        for k in range(min(len(n) - 1, -(-(c - size) // g)), 0, -1):
            if not n[k]:
                continue
            fill = self.at[k][0][0] + size
            if fill > c:
                continue
            after = -(-fill // g)
            change = 1 - 2 * n[k] if self.full(fill) else 0 if after == k else 2 * (n[after] - n[k]) + 2
            if change < gain or (change == gain and not best):
                best, gain = k, change
        return best

    def add(self, key, total: int, ids: np.ndarray) -> Iterator[tuple[list, int]]:
        c = self.capacity
        whole = total // c * c
        for start in range(0, whole, c):
            yield [(key, total, start, ids[start : start + c])], c
        if whole == total:
            return
        piece, size = (key, total, whole, ids[whole:].copy()), total - whole
        if self.waiting:
            self.spare = piece
            waiting, self.waiting = self.waiting, []
            for fill, pieces in waiting:
                yield from self._complete(fill, pieces)
            return
        level = self.place(size)
        fill, pieces = 0, []
        if level:
            fill, pieces = self.at[level].popleft()
            self.level[level] -= 1
            self.open -= 1
        pieces.append(piece)
        self.kept += size
        if self.full(fill + size):
            yield from self._complete(fill + size, pieces)
        else:
            self._put(fill + size, pieces)
        if self.open + len(self.waiting) >= self.max_open:
            yield from self.close(False)

    def _put(self, fill: int, pieces: list) -> None:
        k = -(-fill // self.grain)
        self.level[k] += 1
        self.at[k].append((fill, pieces))
        self.open += 1

    def _complete(self, fill: int, pieces: list) -> Iterator[tuple[list, int]]:
        """Fill a window up from the spare piece; without one it waits."""
        gap = self.capacity - fill
        if gap and self.spare:
            key, total, start, ids = self.spare
            take = min(gap, len(ids))
            pieces.append((key, total, start, ids[:take]))
            self.moved += take
            self.spare = (key, total, start + take, ids[take:]) if take < len(ids) else None
            gap -= take
        if gap:
            self.waiting.append((self.capacity - gap, pieces))
        else:
            yield pieces, self.capacity

    def close(self, last: bool = True) -> Iterator[tuple[list, int]]:
        """Complete the fullest windows with what the least full ones hold; keep the rest open unless this is the end."""
        c = self.capacity
        windows = sorted([*self.waiting, *(w for at in self.at for w in at)], key=lambda w: -w[0])
        rest = deque([self.spare] if self.spare else [])
        self.level[:], self.at, self.open, self.waiting, self.spare = 0, [deque() for _ in self.at], 0, [], None
        first, end, fill, pieces = 0, len(windows), 0, []
        while first < end:
            fill, pieces = windows[first]
            first += 1
            while fill < c and (rest or first < end):
                if not rest:
                    end -= 1
                    rest.extend(windows[end][1])
                    self.kept -= windows[end][0]
                    self.moved += windows[end][0]
                key, total, start, ids = rest.popleft()
                take = min(len(ids), c - fill)
                pieces.append((key, total, start, ids[:take]))
                fill += take
                if take < len(ids):
                    rest.appendleft((key, total, start + take, ids[take:]))
            if fill == c:
                yield pieces, c
                fill, pieces = 0, []
        if not fill:  # what the last donor has left
            pieces = list(rest)
            fill = sum(len(p[3]) for p in pieces)
        if not fill:
            return
        if not last:
            self._put(fill, pieces)
            return
        for bit in range(fill.bit_length() - 1, -1, -1):
            if not fill >> bit & 1:
                continue
            room, out = 1 << bit, []
            while room:
                key, total, start, ids = pieces.pop(0)
                take = min(len(ids), room)
                out.append((key, total, start, ids[:take]))
                room -= take
                if take < len(ids):
                    pieces.insert(0, (key, total, start + take, ids[take:]))
            yield out, 1 << bit


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, ranks_path: str | None = None, max_open: int = MAX_OPEN, special: tuple[tuple[str, int], ...] = SPECIAL, grain: int = GRAIN) -> DataFrame:
    """One row per piece: id, start, length, ids_le (little-endian uint32), doc_tokens, sequence_id, offset, sequence_length.

    A document's ids are those of its whole text and then end_id. Null and empty texts have end_id alone. Repeated rows
    and rows with a null id are packed like any other. An empty table gives no rows. Columns other than the two named
    are not read. Each occurrence of a string in ``special`` has the id given there, as the vocabulary's own tokenizer gives
    it (a file of ranks names no such strings; SPECIAL has the public vocabulary's, and () none). Sequences are filled without gaps; sequence_length is capacity, or a power of two that the ids fill.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = _SCHEMA.format(id=f"`{id_col}`", type=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, packer = tokenizer(ranks_path, special), SumOfSquares(capacity, max_open, grain)
        serial = TaskContext.get().partitionId() << 40
        out: list[tuple] = []
        held = 0
        id_type = None

        def flush():
            keys, starts, lengths, ids, totals, seqs, offsets, padded = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, id_type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64()), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(padded, pa.int64())],
                [id_col, "start", "length", "ids_le", "doc_tokens", "sequence_id", "offset", "sequence_length"],
            )

        def emit(sequences):
            nonlocal serial, held
            for pieces, padded in sequences:
                offset = 0
                for key, total, start, ids in pieces:
                    out.append((key, start, len(ids), ids.astype("<u4").tobytes(), total, serial, offset, padded))
                    offset += len(ids)
                held += offset
                serial += 1
                if held >= 500_000:
                    yield flush()
                    out.clear()
                    held = 0

        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(end_id))
                yield from emit(packer.add(key.as_py(), len(ids), ids))
        yield from emit(packer.close())
        if out:
            yield flush()
        bpe.forget()
        pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
