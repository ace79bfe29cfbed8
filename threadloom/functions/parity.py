"""Sets of tokens as bits that tell most unlike pairs apart.

A set's bits are the parities of its tokens in a power of two of slots. The bits in which
two sets differ are at most the tokens in which they do, and stay so when the wider one is folded
to the width of the other, half on half.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BITS = "_id long, _bucket long, _n int, _bits binary"
#: Slots at least; rows and columns of a tile; pairs held before all but the first of each item go.
NARROW, TALL, WIDE, HELD = 512, 64, 1024, 1 << 21


def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _bucket, _n, _bits) of (_id, _bucket, _load: distinct hashes of tokens)."""
    for batch in batches:
        loads = batch["_load"]
        sizes = np.asarray(loads.value_lengths(), dtype=np.int64)
        widths = np.maximum(NARROW, 1 << np.ceil(np.log2(4 * np.maximum(sizes, 1))).astype(np.int64))
        ends, begun = np.cumsum(widths), np.cumsum(sizes) - sizes
        x = np.asarray(loads.flatten(), dtype=np.int64).view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)  # splitmix64
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = (x ^ (x >> np.uint64(31))).view(np.int64)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 22))))
            own, width = sizes[at:to], widths[at:to]
            starts = np.cumsum(width) - width
            row = np.repeat(np.arange(to - at), own)
            place = starts[row] + (x[begun[at] : begun[at] + own.sum()] & (width[row] - 1))
            marks = np.packbits((np.bincount(place, minlength=int(width.sum())) & 1).astype(np.uint8), bitorder="little")
            offsets = np.append(starts, width.sum()).astype(np.int32) // 8
            made = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(marks)])
            part = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([part["_id"], part["_bucket"], pa.array(own.astype(np.int32)), made], names=["_id", "_bucket", "_n", "_bits"])
            at = to


def folded(words: np.ndarray) -> np.ndarray:
    """Rows of bits at half the width."""
    half = words.shape[1] // 2
    return words[:, :half] ^ words[:, half:]


class _Sets:
    """Sets of one width, by size."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, words: np.ndarray) -> None:
        by = np.argsort(sizes, kind="stable")
        self.ids, self.sizes, self.at, self.words = ids[by], sizes[by], at[by], words[by]


def _by_width(batch: pa.Table, rows: np.ndarray) -> dict[int, _Sets]:
    """The sets of some rows, by the number of their words."""
    column = batch["_bits"]
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    ids, sizes, at = (batch[c].to_numpy() for c in ("_id", "_n", "_at"))
    words = (np.diff(offsets) // 8)[rows]
    out = {}
    for width in np.unique(words):
        own = rows[words == width]
        taken = np.stack([data[offsets[r] : offsets[r + 1]] for r in own]).view(np.uint64)
        out[int(width)] = _Sets(ids[own], sizes[own].astype(np.int64), at[own], taken)
    return out


def _close(a: _Sets, b: _Sets, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of pairs that may reach the threshold; a is as wide as b or half as wide. Where both are the same, each pair once."""
    same, part = a is b, (1 - threshold) / (1 + threshold)
    wide = folded(b.words) if b.words.shape[1] > a.words.shape[1] else b.words
    rows, columns = np.ascontiguousarray(folded(a.words).T), np.ascontiguousarray(folded(wide).T)
    kind = np.uint16 if len(rows) < 1000 else np.uint32
    limit, other = (part * a.sizes + 1e-3).astype(np.float32), (part * b.sizes + 1e-3).astype(np.float32)
    mixed, ones = np.empty((TALL, WIDE), dtype=np.uint64), np.empty((TALL, WIDE), dtype=np.uint8)
    for s in range(0, len(a.sizes), TALL):
        e = min(s + TALL, len(a.sizes))
        first = int(np.searchsorted(b.sizes, threshold * a.sizes[s] - 1e-6, "left"))
        last = int(np.searchsorted(b.sizes, a.sizes[e - 1] / threshold + 1e-6, "right"))
        for c in range(max(first, s + 1) if same else first, last, WIDE):
            d = min(c + WIDE, last)
            x, n = mixed[: e - s, : d - c], ones[: e - s, : d - c]
            apart = np.zeros((e - s, d - c), dtype=kind)
            for k in range(len(rows)):
                np.bitwise_xor(rows[k, s:e, None], columns[k, None, c:d], out=x)
                np.bitwise_count(x, out=n)
                apart += n
            i, j = np.nonzero(apart <= limit[s:e, None] + other[None, c:d])
            i, j = i + s, j + c
            if same:
                i, j = i[i < j], j[i < j]
            step = max(1, (1 << 20) // a.words.shape[1])
            for at in range(0, len(i), step):  # what is left, by all bits
                p, q = i[at : at + step], j[at : at + step]
                n_p, n_q = a.sizes[p], b.sizes[q]
                near = np.bitwise_count(a.words[p] ^ wide[q]).sum(axis=1, dtype=np.int64) <= part * (n_p + n_q) + 1e-3
                near &= np.minimum(n_p, n_q) >= threshold * np.maximum(n_p, n_q) - 1e-6
                yield p[near], q[near]


def _firsts(own: np.ndarray, by: np.ndarray, front: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``front`` of each item's."""
    order = np.lexsort((by, own))
    own, by = own[order], by[order]
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)
    nth = np.arange(len(own)) - np.repeat(begins, np.diff(np.append(begins, len(own))))
    return own[nth < front], by[nth < front]


def meeting(threshold: float, front: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_id, _id_by) of rows (_bucket, _lo, _hi, _id, _n, _at, _rank, _bits) sorted by the first three, which are the task: items with an ``_at``,
    each with the first earlier ones from there on in its task that their bits leave."""

    def met(task: pa.Table) -> pa.RecordBatch:
        task = task.combine_chunks().to_batches()[0]
        opened = np.asarray(task["_at"].is_valid())
        task = task.set_column(task.schema.get_field_index("_at"), "_at", task["_at"].fill_null(np.iinfo(np.int64).max))
        low = task["_rank"].to_numpy() == task["_lo"][0].as_py()
        alone = task["_lo"][0].as_py() == task["_hi"][0].as_py()
        sides = [_by_width(task, np.flatnonzero(low & opened)), _by_width(task, np.flatnonzero(low & ~opened))]
        others = sides if alone else [_by_width(task, np.flatnonzero(~low & opened)), _by_width(task, np.flatnonzero(~low & ~opened))]
        # two that are decided don't meet
        meet = [(sides[0], others[0]), (sides[0], others[1])] + ([] if alone else [(sides[1], others[0])])
        own, by, held = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
        for some, rest in meet:
            for width, a in some.items():
                near = [(a, rest[width])] if width in rest else []
                near += [(a, rest[2 * width])] if 2 * width in rest else []
                near += [(rest[width // 2], a)] if width // 2 in rest and some is not rest else []
                for x, y in near:
                    for i, j in _close(x, y, threshold):
                        late = x.ids[i] > y.ids[j]
                        mine, theirs = np.where(late, x.ids[i], y.ids[j]), np.where(late, y.ids[j], x.ids[i])
                        use = theirs >= np.where(late, x.at[i], y.at[j])
                        own.append(mine[use])
                        by.append(theirs[use])
                        held += len(own[-1])
                        if held > HELD:
                            first = _firsts(np.concatenate(own), np.concatenate(by), front)
                            own, by, held = [first[0]], [first[1]], 0
        return pa.RecordBatch.from_arrays([pa.array(v) for v in _firsts(np.concatenate(own), np.concatenate(by), front)], names=["_id", "_id_by"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("_bucket", "_lo", "_hi")])
            begins = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else []
            for s, e in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, s])
                if key != now and open_:
                    yield met(pa.Table.from_batches(open_))
                    open_ = []
                now = key
                open_.append(batch.slice(s, e - s))
        if open_:
            yield met(pa.Table.from_batches(open_))

    return each


def followed(own: np.ndarray, by: np.ndarray, waiting: np.ndarray, more: set[int]) -> tuple[list[int], list[int], list[int], np.ndarray]:
    """(kept, gone, left, which links are left) of the waiting items, in their order; what is linked to and not waiting is kept."""
    order = np.argsort(own, kind="stable")
    mine = np.sort(waiting)
    starts, ends = (np.searchsorted(own[order], mine, side) for side in ("left", "right"))
    targets = by[order].tolist()
    told: dict[int, int] = {}  # 0: kept, 1: undecided, 2: gone
    for x, s, e in zip(mine.tolist(), starts.tolist(), ends.tolist(), strict=True):
        least = min((told.get(y, 0) for y in targets[s:e]), default=2)
        told[x] = 2 if least == 0 else 1 if least == 1 or x in more else 0
    out = [[x for x, t in told.items() if t == kind] for kind in (0, 2, 1)]
    return *out, np.array([told[x] == 1 and told.get(y, 0) == 1 for x, y in zip(own.tolist(), by.tolist(), strict=True)], dtype=bool)
