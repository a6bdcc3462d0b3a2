"""Vector bin packing of examples into training sequences.

A sequence has room for so many tokens, segments and loss-bearing tokens at once. Of the
examples that fit, the one whose demand has the largest dot product with the room goes in
first, then the one whose demand, scaled to length one, has the largest with the room left:
what points where room is left over, so that no limit is used up before the others. Each task packs the examples it reads, some thousands at a time; what makes no full
sequence waits for the next ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoding, pattern_of
from .common import documents_of, ship_code, slices
from .pretokens import load

END_ID = 1
#: Examples, or tokens of examples, that are packed together.
WINDOW, WINDOW_TOKENS = 4_096, 2 << 20
#: Without cuts, a sequence that is full to this part doesn't wait for more.
FULL = 0.95
#: Sequences of a task are numbered from partition * TASK on.
TASK = 1 << 40
#: Turns of a conversation that are read by one task; a longer conversation goes on in another.
TURNS = 1_000

PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long"


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass(slots=True)
class Example:
    """Ids of a document or conversation from `start` on, and which of them bear loss."""

    doc: int | None
    start: int
    ids: np.ndarray
    loss: np.ndarray
    total: int

    def cut(self, n: int) -> tuple[Example, Example]:
        return (Example(self.doc, self.start, self.ids[:n], self.loss[:n], self.total), Example(self.doc, self.start + n, self.ids[n:], self.loss[n:], self.total))

    def prefix(self, tokens: int, loss: int) -> int:
        """Of how many ids the longest beginning within both limits is."""
        n = min(tokens, len(self.ids))
        before = np.cumsum(self.loss[:n], dtype=np.int64)
        return int(np.searchsorted(before, loss, side="right"))


class Packer:
    """Packs examples as they come. `cut`: examples may be cut anywhere, so that only whole sequences are made.

    With `cut` an example is cut to fill a sequence where none fits. A sequence that can't be
    filled, because segments or loss-bearing tokens or examples run out, ends at the largest
    power of two, and the rest goes on. Without it an example is cut only if it is beyond the
    limits alone, and sequences end where no example fits.
    """

    def __init__(self, limits: Limits, cut: bool, first: int = 0):
        if min(limits) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.cut, self.next = limits, cut, first
        self.pool: list[Example] = []
        self.held = 0
        self.made: list[tuple[Example, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray, loss: np.ndarray) -> None:
        rest = Example(doc, 0, ids, loss, len(ids))
        while len(rest.ids) >= self.limits.tokens or rest.loss.sum() > self.limits.loss:
            part, rest = rest.cut(rest.prefix(self.limits.tokens, self.limits.loss))
            if len(part.ids) == self.limits.tokens:
                self._close([part])
            else:
                self._wait(part)
        if len(rest.ids):
            self._wait(rest)
        if len(self.pool) >= WINDOW or self.held >= WINDOW_TOKENS:
            self.pack(last=False)

    def _wait(self, e: Example) -> None:
        self.pool.append(e)
        self.held += len(e.ids)

    def _close(self, sequence: list[Example]) -> None:
        at = 0
        for e in sequence:
            self.made.append((e, self.next, at))
            at += len(e.ids)
        self.next += 1

    def pack(self, last: bool) -> None:
        """Sequences of what waits. Unless it is the last time, those that aren't full go back and wait, if they are not too many."""
        short: list[tuple[int, list[Example]]] = []
        full = self.limits.tokens
        for sequence in self._sequences():
            tokens = sum(len(e.ids) for e in sequence)
            if tokens == full or not self.cut and not last and tokens >= FULL * full:
                self._close(sequence)
            else:
                short.append((tokens, sequence))
        self.pool, self.held = [], 0
        for tokens, sequence in sorted(short, key=lambda s: s[0]):
            if not last and len(self.pool) + len(sequence) <= WINDOW // 2 and self.held + tokens <= WINDOW_TOKENS // 2:
                for e in sequence:
                    self._wait(e)
            elif not self.cut:
                self._close(sequence)
            else:
                self._halves(sequence)

    def _halves(self, sequence: list[Example]) -> None:
        """Sequences of powers of two, the largest first."""
        while sequence:
            room = 1 << (sum(len(e.ids) for e in sequence).bit_length() - 1)
            own: list[Example] = []
            while room:
                e = sequence.pop(0)
                if len(e.ids) > room:
                    e, rest = e.cut(room)
                    sequence.insert(0, rest)
                own.append(e)
                room -= len(e.ids)
            self._close(own)

    def _sequences(self) -> Iterator[list[Example]]:
        """Of all that waits, by the dot product of demand and room, both as parts of the limits."""
        caps = np.array(self.limits, float)
        pool = self.pool
        need = np.array([[len(e.ids), 1, e.loss.sum()] for e in pool], float).reshape(len(pool), 3)
        live = np.ones(len(pool), bool)
        left = len(pool)
        while left:
            # dimensions count by what they are short of
            weight = need[live].sum(0) / caps
            weight = weight / max(weight.sum(), 1e-9) / caps**2
            size = np.sqrt(need**2 @ weight)
            room, own = caps.copy(), []
            while left:
                fits = live & (need[:, 0] <= room[0]) & (need[:, 2] <= room[2])
                dot = need @ (weight * room)
                score = np.where(fits, dot / size if own else dot, -1.0)
                k = int(score.argmax())
                if fits[k]:
                    own.append(pool[k])
                    room -= need[k]
                    live[k] = False
                    left -= 1
                elif self.cut:
                    k = int(np.where(live, need[:, 0], -1.0).argmax())
                    n = pool[k].prefix(int(room[0]), int(room[2]))
                    if not n:
                        break
                    part, pool[k] = pool[k].cut(n)
                    own.append(part)
                    used = np.array([n, 1, part.loss.sum()], float)
                    room -= used
                    need[k] -= used * (1, 0, 1)
                    size[k] = np.sqrt(need[k] ** 2 @ weight)
                else:
                    break
                if room[0] < 1 or room[1] < 1:
                    break
            yield own

    def rows(self) -> pa.RecordBatch:
        """Pieces of the sequences closed since the last time."""
        made, self.made = self.made, []
        long = lambda values: pa.array(values, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                long([e.doc for e, _, _ in made]), long([e.start for e, _, _ in made]), long([len(e.ids) for e, _, _ in made]),
                pa.array([e.ids.astype("<u4").tobytes() for e, _, _ in made], pa.binary()), long([e.total for e, _, _ in made]),
                long([int(e.loss.sum()) for e, _, _ in made]), long([s for _, s, _ in made]), long([at for _, _, at in made]),
            ],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "loss_tokens", "sequence_id", "offset"],
        )


def packed(df: DataFrame, examples: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], limits: Limits, cut: bool) -> DataFrame:
    """`examples` turns a task's batches into (doc_id, ids, loss). Tasks are packed by themselves, so one that is repeated alone gives whole sequences again."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut, TaskContext.get().partitionId() * TASK)
        for doc, ids, loss in examples(batches):
            packer.add(doc, ids, loss)
            if len(packer.made) >= WINDOW // 4:
                yield packer.rows()
        while packer.pool:
            packer.pack(last=True)
        yield packer.rows()

    return df.mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), cut: bool = True) -> DataFrame:
    """Documents in sequences, one row per piece: doc_id, start (ids of the document before it), length, ids
    (little-endian unsigned 32-bit integers), doc_tokens, loss_tokens, sequence_id, offset (place in the sequence).

    Ids are those of the byte-level BPE file `tokenizer` without special tokens added, and
    END_ID behind each document; every id but a document's first bears loss. Null and empty
    texts are END_ID alone. Repeated rows are documents each; other columns are not read. Very
    long texts give full sequences as they are read. An empty table gives no rows. Numbers of
    sequences name the task and depend on how the table is split.
    """
    file, pattern = load(tokenizer), pattern_of()
    sent = docs.sparkSession.sparkContext.broadcast((file, pattern))  # a few MB

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = encoding(*sent.value)
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(_ids(known, text), np.uint32(END_ID))
                    loss = np.ones(len(ids), bool)
                    loss[0] = False
                    yield doc, ids, loss

    return packed(documents_of(docs), examples, limits, cut)


def pack_conversations(turns: DataFrame, tokenizer: str, limits: Limits = Limits(), bearing: tuple[str, ...] = ("assistant",), cut: bool = False) -> DataFrame:
    """turns(conv_id, turn, role, text): a conversation is an example, of its turns' ids with END_ID behind each; those of
    roles in `bearing` bear loss. Columns as pack_documents(), doc_id being conv_id.

    Turns are in the order of turn (null first), then role and text. Conversations are kept
    whole where they are within the limits and of at most TURNS turns; the turns of a longer
    one go to several tasks and are examples for each TURNS, `start` counting from the first
    of these. Null texts are empty, null roles bear no loss. Rows without conv_id or turn are
    examples of what has one hash of turn, role and text.
    """
    file, pattern = load(tokenizer), pattern_of()
    spark = turns.sparkSession
    sent = spark.sparkContext.broadcast((file, pattern))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = turns.select(
        turns["conv_id"].cast("long").alias("conv_id"), turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
    )
    # rows that name no place in a conversation are spread
    some = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), -1 - F.pmod(F.xxhash64("turn", "role", "text"), F.lit(TURNS))).otherwise(F.expr(f"turn div {TURNS}"))
    own = own.withColumn("some", some)
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "some", "turn", "role", "text")]
    dealt = own.repartition(parts, "conv_id", "some").sortWithinPartitions(*keys)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = encoding(*sent.value)
        key, ids, loss = None, [], []
        for batch in batches:
            for conv, some, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "some", "role", "text")], strict=True):
                # what is beyond a window is an example of its own, so that a key of very many rows isn't held
                if ids and ((conv, some) != key or sum(map(len, ids)) > WINDOW_TOKENS):
                    yield key[0], np.concatenate(ids), np.concatenate(loss)
                    ids, loss = [], []
                key = conv, some
                ids.append(np.append(_ids(known, text), np.uint32(END_ID)))
                loss.append(np.full(len(ids[-1]), role in bearing))
        if ids:
            yield key[0], np.concatenate(ids), np.concatenate(loss)

    return packed(dealt, examples, limits, cut)


def _ids(known: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.array(known.encode(text, allowed_special="all"), np.uint32)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_segments, loss_tokens, ids): whole sequences, each of at most the limits' tokens."""
    own = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.count("*").alias("n_segments"), F.sum("loss_tokens").alias("loss_tokens"),
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
    )
    ids = F.aggregate("parts", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    return own.select("sequence_id", "n_tokens", "n_segments", "loss_tokens", ids.alias("ids"))
