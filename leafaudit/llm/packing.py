"""Harmonic packing of token sequences, worker by worker.

A document is cut into whole sequences and a rest. The rest is cut at reciprocals of the
capacity: the largest capacity/k that fits is cut off, a few times; what is left stays
as one piece. A piece of length in (capacity/(k+1), capacity/k] belongs to class k, and
k pieces of class k share a sequence. Each worker fills the sequences of its own
partition. At its end, the pieces of sequences that did not fill are laid end to end and
cut at the capacity, so a worker leaves one short sequence at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafaudit.llm.bpe import Vocabulary
from leafaudit.llm.common import each_batch, text_or_empty

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
#: Class numbers from this one on share one class that is filled end to end.
LAST_CLASS = 64


def cut_lengths(total: int, capacity: int, cuts: int) -> list[int]:
    """Lengths of the pieces of a document of that many tokens. A rest that fills its
    class's sequences to within a 64th, or is as short as that, is not cut further."""
    out, rest = [capacity] * (total // capacity), total % capacity
    for _ in range(cuts):
        k = capacity // max(rest, 1)
        if k >= LAST_CLASS or capacity - k * rest <= capacity // 64:
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


class Packer:
    """Sequences of one worker. Holds only the open sequence of each class."""

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next_id = capacity, worker << 36
        self.open: dict[int, list[tuple]] = {}
        self.filled: dict[int, int] = {}
        self.out: list[tuple] = []

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        length = len(ids) // 4
        k = min(self.capacity // length, LAST_CLASS)
        held = self.open.setdefault(k, [])
        if k == LAST_CLASS and self.filled.get(k, 0) + length > self.capacity:
            self.close(k)
            held = self.open.setdefault(k, [])
        held.append((doc, start, ids, total))
        self.filled[k] = self.filled.get(k, 0) + length
        if k < LAST_CLASS and len(held) == k:
            self.close(k)

    def close(self, k: int) -> None:
        at = 0
        for doc, start, ids, total in self.open.pop(k, []):
            n = len(ids) // 4
            self.out.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.filled[k] = 0
        self.next_id += 1

    def finish(self) -> None:
        at = 0
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while ids:
                    part = ids[: 4 * (self.capacity - at)]
                    n = len(part) // 4
                    self.out.append((doc, start, n, zlib.crc32(part), total, self.next_id, at))
                    ids, start, at = ids[4 * n :], start + n, at + n
                    if at == self.capacity:
                        self.next_id, at = self.next_id + 1, 0
        self.open.clear()

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [[]] * len(NAMES)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def pack(docs: DataFrame, vocabulary_path: str, *, capacity: int = 2048, end_id: int = 1, cuts: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents (their ids, then end_id) into sequences of at most that capacity.

    Returns one row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset). A null text counts as empty: its document is the end id alone. Repeated rows
    are packed each; a null id stays null; other columns are ignored; an empty table gives
    no rows. No shuffle: a lost task is packed again from its own partition, and sequence
    ids hold the partition's number, so they don't clash."""
    vocabulary = Vocabulary.read(vocabulary_path)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, TaskContext.get().partitionId())
        for batch in each_batch(batches, 512):
            words = [vocabulary.keys_of(t) for t in batch.column(1).to_pylist()]
            table = vocabulary.encode_ids(set().union(*words))
            for doc, ws in zip(batch.column(0).to_pylist(), words, strict=True):
                ids = b"".join(map(table.__getitem__, ws)) + tail
                start = 0
                for n in cut_lengths(len(ids) // 4, capacity, cuts):
                    packer.add(doc, start, ids[4 * start : 4 * (start + n)], len(ids) // 4)
                    start += n
            yield packer.take()
        packer.finish()
        yield packer.take()

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return picked.mapInArrow(run, SCHEMA)
