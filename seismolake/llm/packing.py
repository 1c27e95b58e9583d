"""Hierarchical multi-length packing of documents into training sequences.

A document's whole top-size windows are cut off first; its tail is routed to the smallest context
tier that holds it. Within a packing group (a bounded run of documents of one partition) the tiers
are packed from the longest to the shortest: a top-tier tail opens a long window, whose gap is
filled with the longest waiting tails of shorter tiers that fit; a tail of a shorter tier is paired
with one that completes its tier exactly, else it opens a long window too. Long windows that still
have a gap of `least_cut` ids or more are filled with cuts from the emptiest windows. What is left
of the group, less than one long window, is laid out in full windows of powers of two.

Groups are independent, so nothing is shuffled, and a lost task is only run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import small_batches

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_tokens int, step_group long"

Piece = tuple[int, int, int]  # document in the group, start, length


def plan_windows(lengths: list[int], tiers: tuple[int, ...] = TIERS, least_cut: int = 32) -> list[tuple[int, list[Piece]]]:
    """(window size, pieces) of each window of one group of documents with the given token counts."""
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    waiting: dict[int, list[tuple[int, int]]] = {}
    present = 0  # bit n: a tail of length n waits
    for doc, n in enumerate(lengths):
        cut = n - n % top
        windows.extend((top, [(doc, at, top)]) for at in range(0, cut, top))
        if n > cut:
            waiting.setdefault(n - cut, []).append((doc, cut))
            present |= 1 << (n - cut)

    def take(most: int, exact: bool = False) -> Piece | None:
        nonlocal present
        n = (present & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 1 or exact and n != most:
            return None
        doc, start = waiting[n].pop()
        if not waiting[n]:
            present ^= 1 << n
        return doc, start, n

    partial: list[tuple[int, list[Piece]]] = []  # gap, pieces
    while (first := take(top)) is not None:
        tier = next(t for t in tiers if t >= first[2])
        if tier < top:
            if first[2] == tier:
                windows.append((tier, [first]))
                continue
            if (second := take(tier - first[2], exact=True)) is not None:
                windows.append((tier, [first, second]))
                continue
        pieces, gap = [first], top - first[2]
        while gap and (piece := take(gap)) is not None:
            pieces.append(piece)
            gap -= piece[2]
        if gap:
            partial.append((gap, pieces))
        else:
            windows.append((top, pieces))

    partial.sort(key=lambda x: x[0])
    donors: list[Piece] = []

    def draw(most: int) -> list[Piece]:
        got = []
        while most and donors:
            doc, start, n = donors.pop()
            if n > most:
                donors.append((doc, start + most, n - most))
                n = most
            got.append((doc, start, n))
            most -= n
        return got

    while partial:
        gap, pieces = partial.pop(0)
        if gap >= least_cut:
            while partial and sum(p[2] for p in donors) < gap:
                donors.extend(partial.pop()[1])
            if sum(p[2] for p in donors) < gap:
                donors.extend(pieces)
                break
            pieces = pieces + draw(gap)
        windows.append((top, pieces))
    while left := sum(p[2] for p in donors):
        size = min(top, 1 << (left.bit_length() - 1))
        windows.append((size, draw(size)))
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A step group for each window: windows of one size and about step_tokens ids, with attention costs evened by dealing the costliest in turn, to and fro."""
    out, used = [0] * len(windows), 0
    for size in sorted({size for size, _ in windows}):
        own = sorted((k for k, w in enumerate(windows) if w[0] == size), key=lambda k: -sum(p[2] ** 2 for p in windows[k][1]))
        n = -(-len(own) * size // step_tokens)
        for rank, k in enumerate(own):
            turn, at = divmod(rank, n)
            out[k] = used + (n - 1 - at if turn % 2 else at)
        used += n
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, group_tokens: int = 1 << 22, step_tokens: int = 1 << 18, least_cut: int = 32) -> DataFrame:
    """Pieces of all documents (doc_id, text): where each lies in its document and in its sequence.

    window_tokens is the sequence's context size, step_group the training step that it suits.
    A null or empty text is a document of the end id alone. Rows that repeat, or share an id, are
    packed each on its own; a null id stays null. Other columns are not read. An empty table gives
    no rows. sequence_id is unique over partitions: the partition's number times 2^32, plus a count.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    end = int(end_id).to_bytes(4, "little")

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .token_words import encoder

        encode = encoder(tokenizer).encode
        base = TaskContext.get().partitionId() << 32
        sequences = steps = held = 0
        group: list[tuple] = []
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_tokens", "step_group")

        def packed() -> Iterator:
            nonlocal sequences, steps
            windows = plan_windows([len(ids) // 4 for _, ids in group], tiers, least_cut)
            groups = step_groups(windows, step_tokens)
            columns: list[list] = [[] for _ in names]
            for (size, inside), step in zip(windows, groups, strict=True):
                offset = 0
                for doc, start, n in inside:
                    doc_id, ids = group[doc]
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)])
                    for column, value in zip(columns, (doc_id, start, n, crc, len(ids) // 4, base + sequences, offset, size, base + steps + step), strict=True):
                        column.append(value)
                    offset += n
                sequences += 1
            steps += max(groups, default=-1) + 1
            types = [id_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            for at in range(0, len(columns[0]), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], t) for c, t in zip(columns, types, strict=True)], names)

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                group.append((doc_id, ids))
                held += len(ids) // 4
                if held >= group_tokens:
                    yield from packed()
                    group.clear()
                    held = 0
        if group:
            yield from packed()

    return docs.mapInArrow(pieces, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))
