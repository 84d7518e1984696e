"""Best-fit packing of documents into sequences by bin completion.

Lengths are whole numbers up to the capacity, so the whole corpus is described
by a histogram of at most ``capacity`` counts, whatever its size. The driver
packs that histogram by bin completion (Korf 2002; Martello and Toth's
dominance): around the largest length left it enumerates undominated fillings,
prunes those whose waste exceeds what the lower bound still allows, and keeps
the best-fit solution as the incumbent. One filling is applied to as many
sequences as the counts let it, so a plan has a few thousand rows at most.

Executors then place every piece by its rank among the pieces of its length:
ranks come from a salted numbering, places from a binary search in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import free_name, kept, salted_rank
from siftwell.llm.tokens import blocks, small_batches, vocabulary_path

CAPACITY = 2048
#: Fixed value of the contract: the id that ends each document.
END_ID = 0
#: Fillings that the search looks at around one largest length, and in all.
WIDTH, BUDGET = 64, 20_000

Filling = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Run:
    """``bins`` sequences that each hold the same lengths: (length, times), largest first."""

    bins: int
    items: Filling


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by lengths over half (Martello and Toth's L2)."""
    if not counts:
        return 0
    sizes = np.array(sorted(counts), np.int64)
    number = np.array([counts[s] for s in sizes.tolist()], np.int64)
    n, volume = np.concatenate(([0], np.cumsum(number))), np.concatenate(([0], np.cumsum(sizes * number)))
    half = np.searchsorted(sizes, capacity // 2, "right")
    k = np.concatenate(([0], sizes[:half]))
    full = np.searchsorted(sizes, capacity - k, "right")  # from here on nothing of length k fits beside
    middle = n[full] - n[half]
    room = capacity * middle - (volume[full] - volume[half])
    small = volume[half] - volume[np.searchsorted(sizes, k)]
    need = n[-1] - n[full] + middle + np.maximum(0, -(-(small - room) // capacity))
    return int(max(-(-volume[-1] // capacity), need.max()))


def _fullest(room: int, sizes: list[int], counts: dict[int, int]) -> Filling:
    """The filling of ``room`` with the least waste, of few and large lengths: the best-fit completion.

    ``sizes`` are the lengths with a count, ascending. One and two lengths are
    tried first; else reachable sums are bits of one integer.
    """
    at = bisect.bisect_right(sizes, room)
    if not at:
        return ()
    if sizes[at - 1] == room:
        return ((room, 1),)
    for i in range(at - 1, -1, -1):
        a = sizes[i]
        if 2 * a < room:
            break
        b = room - a
        if b == a and counts[a] > 1:
            return ((a, 2),)
        if b != a and counts.get(b, 0):
            return ((a, 1), (b, 1))
    mask, sums, steps = (1 << room + 1) - 1, 1, []
    for i in range(at - 1, -1, -1):
        left, part = min(counts[sizes[i]], room // sizes[i]), 1
        while left:
            part = min(part, left)
            steps.append((sizes[i], part, sums))
            sums |= sums << sizes[i] * part & mask
            left, part = left - part, 2 * part
        if sums >> room & 1:
            break
    fill, used = sums.bit_length() - 1, Counter()
    for size, part, before in reversed(steps):
        if not before >> fill & 1:
            used[size] += part
            fill -= size * part
    return tuple(sorted(used.items(), reverse=True))


def _fillings(room: int, sizes: list[int], counts: dict[int, int], allowed: int, limit: float) -> list[Filling]:
    """Undominated fillings of ``room`` with waste up to ``allowed``; the first ``limit`` by waste are looked at.

    A filling is dominated if a length left over fits into its waste, or could
    take the place of one of its lengths and use more of the room.
    """
    found: list[tuple[int, int, Filling]] = []
    looked, mask, sums, reach = 0, (1 << room + 1) - 1, 1, []
    for size in sizes:  # bits of the sums that the lengths up to each one reach
        left, part = min(counts[size], room // size), 1
        while left:
            part = min(part, left)
            sums |= sums << size * part & mask
            left, part = left - part, 2 * part
        reach.append(sums)

    def descend(i: int, left: int, waste: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal looked
        if not left:
            looked += 1
            if not dominated(waste, dict(chosen)):
                found.append((waste, sum(n for _, n in chosen), tuple(chosen)))
            return
        while i >= 0 and looked < limit and reach[i] >> left & 1:
            for n in range(min(counts[sizes[i]], left // sizes[i]), 0, -1):
                rest = left - n * sizes[i]
                if looked < limit and (not rest or i and reach[i - 1] >> rest & 1):
                    descend(i - 1, rest, waste, [*chosen, (sizes[i], n)])
            i -= 1

    def dominated(left: int, used: dict[int, int]) -> bool:
        if left == 0:
            return False
        free = [s for s in sizes if counts[s] > used.get(s, 0)]
        if any(s <= left for s in free):
            return True
        return any(u < s <= u + left for u in used for s in free)

    for waste in range(min(allowed, room) + 1):
        descend(len(sizes) - 1, room - waste, waste, [])
    return [f for _, _, f in sorted(found)]


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, budget: int | None = BUDGET, width: int | None = WIDTH) -> list[Run]:
    """A packing of the histogram ``counts`` (length: how many) into few sequences.

    With ``budget`` and ``width`` None the search goes on until the packing is
    proved smallest, however long that takes.

    The incumbent is the better of best-fit decreasing and of a first descent
    that takes the best-fit completion of the largest length each time. If it
    needs more than the lower bound, other undominated fillings are tried, up to ``budget`` nodes, and a branch ends
    when its waste leaves no room for fewer sequences than the incumbent. With
    the budget spent the incumbent is returned: a whole packing, maybe not the
    smallest.
    """
    budget, width = (float("inf") if x is None else x for x in (budget, width))
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    least = lower_bound(counts, capacity)
    best = min(_descend(counts, capacity), _best_fit(counts, capacity), key=lambda runs: (sum(r.bins for r in runs), len(runs)))
    need = sum(r.bins for r in best)
    total = sum(s * n for s, n in counts.items())

    def branches(left: dict[int, int], used: int, waste: int) -> Iterator[tuple[Run, dict[int, int], int, int]]:
        """What may follow: a run of the largest length's fillings, the lengths then left, and the sums."""
        if (need - 1) * capacity - total < waste or used + lower_bound(left, capacity) >= need:
            return
        largest = max(left)
        room = capacity - largest
        rest = left | {largest: left[largest] - 1}
        sizes = sorted(s for s, n in rest.items() if n and s <= room)
        first = _fullest(room, sizes, rest)
        for filling in [first, *(f for f in _fillings(room, sizes, rest, (need - 1) * capacity - total - waste, width) if f != first)]:
            gap = room - sum(s * n for s, n in filling)
            whole = Counter(dict(filling))
            whole[largest] += 1
            most = min(left[s] // n for s, n in whole.items())
            for bins in dict.fromkeys((most, 1)):
                if waste + gap * bins <= (need - 1) * capacity - total:
                    after = {s: k for s, n in left.items() if (k := n - whole.get(s, 0) * bins)}
                    yield Run(bins, tuple(sorted(whole.items(), reverse=True))), after, used + bins, waste + gap * bins

    stack, path, nodes = [branches(counts, 0, 0)], [], 0
    while stack and need > least and nodes < budget:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            del path[len(stack) - 1 :]
            continue
        nodes += 1
        run, left, used, waste = step
        if left:
            path.append(run)
            stack.append(branches(left, used, waste))
        elif used < need:
            best, need = [*path, run], used
    return best


def _descend(counts: dict[int, int], capacity: int) -> list[Run]:
    left, sizes, runs = dict(counts), sorted(counts), []
    while sizes:
        largest = sizes[-1]
        left[largest] -= 1
        room = capacity - largest
        usable = sizes[:-1] if not left[largest] else sizes
        whole = Counter(dict(_fullest(room, usable, left)))
        left[largest] += 1
        whole[largest] += 1
        bins = min(left[s] // n for s, n in whole.items())
        runs.append(Run(bins, tuple(sorted(whole.items(), reverse=True))))
        for s, n in whole.items():
            left[s] -= n * bins
        sizes = [s for s in sizes if left[s]]
    return runs


def _best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing over equal sequences at once: each length goes where it leaves the least room."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # room left: (lengths held, sequences)
    rooms: list[int] = []

    def put(room: int, held: tuple[int, ...], bins: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((held, bins))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, (size,) * each, left // each)
                if left % each:
                    put(capacity - left % each * size, (size,) * (left % each), 1)
                break
            room = rooms[at]
            held, bins = groups[room].pop()
            taken = min(left, bins)
            if bins > taken:
                groups[room].append((held, bins - taken))
            elif not groups[room]:
                del groups[room], rooms[at]
            put(room - size, (*held, size), taken)
            left -= taken
    return [Run(bins, tuple(sorted(Counter(held).items(), reverse=True))) for part in groups.values() for held, bins in part]


class Plan:
    """Where the piece of a length and rank goes; at most a few thousand rows, kept as arrays."""

    def __init__(self, runs: list[Run]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter[int] = Counter()
        sequence = 0
        for run in runs:
            offset = 0
            for size, times in run.items:
                rows.setdefault(size, []).append((taken[size], sequence, times, offset))
                taken[size] += times * run.bins
                offset += size * times
            sequence += run.bins
        self.sequences = sequence
        self.rows = {s: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for s, r in rows.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence ids, offsets) of pieces."""
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for size in np.unique(lengths):
            own = lengths == size
            base, first, times, start = self.rows[int(size)]
            i = np.searchsorted(base, ranks[own], "right") - 1
            j = ranks[own] - base[i]
            sequence[own], offset[own] = first[i] + j // times[i], start[i] + j % times[i] * size
        return sequence, offset


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, row) of each document's ids and the end id.

    ``row`` numbers rows by task and place, so that it tells repeated rows apart.

    A null or empty text is the end id alone. Documents of over ``capacity``
    ids are cut into pieces of that many; the last may be shorter.
    """
    path = path or vocabulary_path()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end, width, number = np.array([END_ID], "<u4").tobytes(), 4 * capacity, TaskContext.get().partitionId() << 40
        for doc_ids, texts in blocks(batches, path):
            rows: list[tuple[int | None, int, int, int, int, int]] = []
            for doc_id, ids in zip(doc_ids.to_pylist(), texts, strict=True):
                view = memoryview(ids + end)
                for k, at in enumerate(range(0, len(view), width)):
                    part = view[at : at + width]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), number))
                    number += 1
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(compute, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack(parts: DataFrame, capacity: int = CAPACITY, budget: int | None = BUDGET, width: int | None = WIDTH, tie: list[str] | None = None) -> DataFrame:
    """``parts`` (a row per piece, with long ``length``) with sequence_id and offset.

    Other columns are kept; those named sequence_id or offset are replaced.
    Every row gets a place, repeated rows too. ``tie`` are the columns that
    order rows of one length, all of them unless given; rows alike there may
    change places. Sequence ids count from 0; places in a sequence are gapless
    from 0. An empty table stays empty. ``parts`` is read more than once: pass
    a table. ``budget`` and ``width`` bound the search as in ``complete_bins``.
    """
    parts = parts.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(complete_bins(histogram, capacity, budget, width))
    rank = free_name(parts.columns, "_rank")
    ranked = salted_rank(parts, "length", tie or [c for c in parts.columns if c != "length"] or ["length"], name=rank)
    fields = parts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column(rank).to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(sequence), pa.array(offset)], [*fields, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.select(*fields, rank).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def gap(parts: DataFrame, capacity: int = CAPACITY, budget: int | None = BUDGET, width: int | None = WIDTH) -> tuple[int, int]:
    """(sequences of the packing, lower bound) of the lengths in ``parts``: equal if it is proved smallest."""
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    return sum(r.bins for r in complete_bins(histogram, capacity, budget, width)), lower_bound(histogram, capacity)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, budget: int | None = BUDGET, width: int | None = WIDTH) -> DataFrame:
    """Every document's pieces with their sequence and place there. Only doc_id and text of ``docs`` are read."""
    with small_batches(docs.sparkSession):
        parts = kept(pieces(docs, path, capacity), "pieces")
    return pack(parts, capacity, budget, width, ["row"]).drop("row")


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (sequence_id, ids array<long>): the packed sequences themselves.

    A sequence holds at most the capacity, so its group is bounded. Rows of
    ``docs`` must have distinct, non-null ids.
    """
    path = path or vocabulary_path()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in blocks(batches, path):
            ids = [np.append(np.frombuffer(x, "<u4"), END_ID).astype(np.int64) for x in texts]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    ids = docs.select("doc_id", "text").mapInArrow(compute, "doc_id long, ids array<long>")
    cut = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))
