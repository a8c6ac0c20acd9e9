"""Hierarchical packing of token streams into power-of-two windows."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, forget_others, release, to_arrow

#: Chunks whose ids a worker keeps.
CACHE = 400_000
#: Rows of one output batch.
OUT_ROWS = 20_000
#: Tokens of one step group, and groups that may stand open in a task.
STEP_TOKENS, OPEN_STEPS = 8 * 1024, 16
#: The shortest context size.
SHORTEST = 128
#: Pieces of a tier that wait until its windows are filled.
WAIT = 48


class ByteTokenizer:
    """Ids of a byte-level BPE file, as bytes of little-endian uint32.

    The vocabulary is read from the ``tokenizers`` JSON file; its merge ranks
    are its ids. The file's added tokens are found in texts first, as the
    tokenizer does. A text of single blanks and line feeds between words is looked
    up word by word, which the pre-tokeniser's pattern allows because it never
    joins what stands on both sides of a blank; any other text is encoded whole.
    """

    def __init__(self, content: bytes):
        import tiktoken

        file = json.loads(content)
        model = file["model"]
        letters = byte_letters()
        ranks = {}
        for piece, i in model["vocab"].items():
            if all(c in letters for c in piece):
                ranks[bytes(letters[c] for c in piece)] = i
        self.added = {x["content"]: x["id"] for x in file.get("added_tokens", ())}
        # the pattern of the file's ByteLevel pre-tokeniser (fixed value)
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.core = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.added)
        self.first, self.later = _Cache(self, ""), _Cache(self, " ")
        self.feed = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return np.array(self.core.encode(text, allowed_special="all"), np.uint32).astype("<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return self.whole(text)
        plain = text.replace("\n", "")
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or len(plain.split()) != plain.count(" ") + 1:
            return self.whole(text)
        out = []
        for i, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if i:
                out.append(self.feed)
            out.append(self.first[words[0]])
            out.extend(map(self.later.__getitem__, words[1:]))
        return b"".join(out)


class _Cache(dict):
    def __init__(self, owner: ByteTokenizer, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> bytes:
        value = self.owner.whole(self.lead + word)
        if len(word) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[word] = value
        return value


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_loaded: dict[bytes, ByteTokenizer] = {}
CACHES[__name__] = _loaded.clear


def tokenizer(content: bytes) -> ByteTokenizer:
    """The tokenizer of a vocabulary file's content, built once in a worker."""
    key = hashlib.sha256(content).digest()
    if key not in _loaded:
        _loaded[key] = ByteTokenizer(content)
    return _loaded[key]


class Packer:
    """Packs the documents of one task in several context sizes.

    The tiers are the powers of two from :data:`SHORTEST` to ``window``. A
    document is cut into whole long windows, and its rest is routed to the
    smallest tier that holds it. Each tier is packed in sequences of its own
    length: a sequence opens with a waiting piece of its tier, and its gap is
    filled with the longest waiting pieces of shorter tiers that fit; the last
    one is cut to close the gap exactly, and what is left of it is routed anew.
    Where no shorter piece waits, the next piece of the tier is cut. So every
    sequence is full. At the end what still waits fills sequences of falling
    powers of two. ``wait`` bounds the pieces that wait in a tier.

    Sequences of all tiers go to step groups of equal token counts: one goes to
    the fullest open group with room for it. As all lengths are powers of two,
    groups fill exactly; a group that is full is closed, and if too many stand
    open the fullest is given up as it is.
    """

    def __init__(self, window: int, base: int, wait: int = WAIT, step_tokens: int = STEP_TOKENS, shortest: int = SHORTEST):
        assert window & (window - 1) == 0
        self.window, self.next, self.wait, self.step_tokens = window, base, wait, max(step_tokens, window)
        self.low = (min(shortest, window)).bit_length() - 1
        self.levels = window.bit_length()
        self.tiers: list[deque] = [deque() for _ in range(self.levels)]
        self.held = 0
        self.steps: list[list[int]] = []  # (tokens, group)
        self.step = base
        self.out: list[tuple] = []

    def _group(self, size: int) -> int:
        best = max((g for g in self.steps if g[0] + size <= self.step_tokens), default=None)
        if best is None:
            if len(self.steps) >= OPEN_STEPS:
                self.steps.remove(max(self.steps))
            self.step += 1
            self.steps.append(best := [0, self.step])
        best[0] += size
        if best[0] == self.step_tokens:
            self.steps.remove(best)
        return best[1]

    def _close(self, pieces: list[tuple], size: int) -> None:
        group, at = self._group(size), 0
        for doc, start, length in pieces:
            self.out.append((doc, start, length, self.next, at, size, group))
            at += length
        self.next += 1

    def _tier(self, length: int) -> int:
        return max(self.low, (length - 1).bit_length())

    def _put(self, piece: tuple) -> None:
        self.tiers[self._tier(piece[2])].append(piece)
        self.held += piece[2]

    def _from(self, k: int) -> tuple:
        piece = self.tiers[k].popleft()
        self.held -= piece[2]
        return piece

    def _filler(self, room: int, tier: int) -> tuple:
        """A piece of the longest shorter tier that fits, else a longer one, to be cut."""
        top = min(tier, room.bit_length() - 1)
        for k in (*range(top, -1, -1), *range(top + 1, self.levels)):
            if self.tiers[k]:
                return self._from(k)
        raise AssertionError("nothing waits")

    def _fill(self, size: int, tier: int) -> None:
        """One sequence of ``size`` tokens that opens with a piece of the tier; at least so many must wait."""
        pieces, room = [], size
        while room:
            doc, start, length = self._from(tier) if not pieces else self._filler(room, tier)
            if length > room:
                self._put((doc, start + room, length - room))
                length = room
            pieces.append((doc, start, length))
            room -= length
        self._close(pieces, size)

    def add(self, doc, tokens: int) -> None:
        start = 0
        while tokens - start >= self.window:
            self._close([(doc, start, self.window)], self.window)
            start += self.window
        if tokens > start:
            rest = (doc, start, tokens - start)
            self._put(rest)
            k = self._tier(rest[2])
            while len(self.tiers[k]) > self.wait and self.held >= 1 << k:
                self._fill(1 << k, k)

    def finish(self) -> None:
        for k in range(self.levels - 1, self.low - 1, -1):
            while self.tiers[k] and self.held >= 1 << k:
                self._fill(1 << k, k)
        while self.held:
            self._fill(1 << (self.held.bit_length() - 1), next(k for k in range(self.levels - 1, -1, -1) if self.tiers[k]))


def _content(spark: SparkSession, path: str) -> bytes:
    """A file that the driver sees; else one that Spark does."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, with_ids: bool = False, shortest: int = SHORTEST) -> DataFrame:
    """Cut and pack all documents into sequences of at most ``window`` tokens.

    A document's tokens are the ids of its text and then ``end_id``. Returns one
    row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset``, then ``sequence_tokens`` (the context size of the sequence, a power
    of two), ``step_group`` (sequences of all sizes with together
    :data:`STEP_TOKENS` tokens, fewer in a task's last groups) and, if
    ``with_ids``, the piece's ``ids``. See :class:`Packer`.

    Every task packs what it reads, so nothing is shuffled and no padding is
    needed. The vocabulary file is read by the driver and sent to the tasks.
    Sequence ids hold the task's number, so that they are unique.

    Edge cases: a null text is empty, and an empty text is the end id alone. A
    null document id is packed like any other. Repeated rows are packed each.
    Very long texts give many whole windows. An empty table gives no rows. Other
    columns are ignored.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long" + (", ids array<int>" if with_ids else "")
    arrow = to_arrow(docs.sparkSession, schema)
    tail = np.array([end_id], "<u4").tobytes()
    shared = docs.sparkSession.sparkContext.broadcast(_content(docs.sparkSession, vocabulary))

    def run(batches):
        from pyspark import TaskContext

        forget_others(__name__)
        encode = tokenizer(shared.value).encode
        packer = Packer(window, TaskContext.get().partitionId() << 40, shortest=shortest)

        def rows():
            columns = [[] for _ in range(len(arrow))]
            for (doc, buffer), start, length, sequence, at, size, step in packer.out:
                part = memoryview(buffer)[4 * start : 4 * (start + length)]
                values = (doc, start, length, zlib.crc32(part), len(buffer) // 4, sequence, at, size, step)
                for column, v in zip(columns, values, strict=False):
                    column.append(v)
                if with_ids:
                    columns[-1].append(np.frombuffer(part, "<u4").astype(np.int32))
            packer.out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                buffer = encode(text.as_py() or "") + tail
                packer.add((doc.as_py(), buffer), len(buffer) // 4)
                if len(packer.out) >= OUT_ROWS:
                    yield rows()
        packer.finish()
        yield rows()
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
