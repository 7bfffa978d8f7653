"""Best-fit packing: bin completion on the histogram of piece lengths.

There are at most ``capacity`` different lengths, so the packing problem is
solved over (length, count) pairs. Its size does not grow with the corpus;
pieces then take their places by rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkspark.llm.caches import claim, values
from linkspark.llm.tokens import WordBpe
from linkspark.plans.staging import stage

CAPACITY = 4096
#: The id that ends every document.
END_ID = (1).to_bytes(4, "little")
#: Salt of the ranks within one length, so that a hot length is numbered in parallel.
RANK_BUCKETS = 256
#: Nodes that the branch-and-bound search may visit; the incumbent stands after that.
SEARCH_NODES = 20_000
#: Fillings tried per node, fullest first.
FILLINGS = 24

Pattern = tuple[int, ...]
Packing = list[tuple[Pattern, int]]

# --- the search on the histogram --------------------------------------------


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing can undercut: by volume, and by the items over a half (Martello and Toth's L2)."""
    total = sum(x * c for x, c in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for k in [0, *[x for x in sizes if x <= capacity // 2][:256]]:
        big = sum(c for x, c in counts.items() if x > capacity - k)
        mid = sum(c for x, c in counts.items() if capacity // 2 < x <= capacity - k)
        room = mid * capacity - sum(x * c for x, c in counts.items() if capacity // 2 < x <= capacity - k)
        small = sum(x * c for x, c in counts.items() if k <= x <= capacity // 2)
        best = max(best, big + mid + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best-fit decreasing, run on counts: equal bins and equal items move together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []
    done: Packing = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not room:
            done.append((pattern, n))
        elif room in open_bins:
            open_bins[room].append((pattern, n))
        else:
            open_bins[room] = [(pattern, n)]
            insort(rooms, room)

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                per = capacity // x
                if left >= per:
                    put(capacity - per * x, (x,) * per, left // per)
                if left % per:
                    put(capacity - left % per * x, (x,) * (left % per), 1)
                break
            room = rooms[at]
            pattern, n = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(at)
            per = min(room // x, max(1, left // n)) if n <= left else 1
            bins = min(n, left // per)
            if bins < n:
                put(room, pattern, n - bins)
            put(room - per * x, pattern + (x,) * per, bins)
            left -= per * bins
    return done + [b for bins in open_bins.values() for b in bins]


def _runs(asc: list[int], waste: int) -> list[int]:
    """For each size, where its run of sizes at most ``waste`` apart begins; -1 if the size or one below it in the run is at most ``waste``.

    If an item stays free, so do all smaller ones of its run, as it or they
    could take their place; items no larger than ``waste`` must all be used.
    """
    runs: list[int] = []
    for i, x in enumerate(asc):
        runs.append(-1 if x <= waste else runs[-1] if i and x - asc[i - 1] <= waste else i)
    return runs


def _sums(asc: list[int], counts: dict[int, int], room: int, runs: list[int]) -> list[int]:
    """For each i the bit set of sums that undominated fillings can take from ``asc[:i]``."""
    full, sums = (1 << room + 1) - 1, [1]
    for i, x in enumerate(asc):
        c, most = counts[x], room // x
        out = sums[i] << c * x if c <= most else 0
        if runs[i] >= 0:
            more, have, some = min(c - 1, most), 1, sums[runs[i]]
            while more:
                step = min(have, more)
                some |= some << step * x
                more, have = more - step, have + step
            out |= some
        sums.append(out & full)
    return sums


def fillings(asc: list[int], counts: dict[int, int], room: int, limit: int, most: int | None = None) -> list[Pattern]:
    """The ``limit`` fullest undominated fillings of ``room`` with free items, fullest first.

    ``asc`` lists the sizes in ascending order. A filling is maximal (nothing
    left fits on top) and no item in it can be swapped for a larger free one;
    such a swap would dominate it. All such fillings that leave at most
    ``most`` are enumerated in the order of what they leave, larger items
    first; the sums that can be met lead the enumeration, so that no branch
    of it is in vain.
    """
    asc = asc[: bisect_right(asc, room)]
    found: list[Pattern] = []
    any_ = _sums(asc, counts, room, _runs(asc, 0))
    for waste in range(min(room, room if most is None else most) + 1):
        if not any_[-1] >> room - waste & 1:
            continue
        runs = _runs(asc, waste)
        sums = _sums(asc, counts, room, runs) if waste else any_
        stack: list[tuple[int, int, Pattern]] = [(len(asc), room - waste, ())]
        level: list[Pattern] = []
        while stack and len(found) + len(level) < limit:
            i, left, taken = stack.pop()
            if not sums[i] >> left & 1:
                continue
            top = bisect_right(asc, left, 0, i)
            if top < i:  # sizes that do not fit stay free
                if runs[top] >= 0:
                    stack.append((runs[top], left, taken))
            elif not i:
                level.append(taken)
            else:
                x = asc[i - 1]
                if runs[i - 1] >= 0:
                    stack += [(runs[i - 1], left - k * x, taken + (x,) * k) for k in range(min(counts[x] - 1, left // x) + 1)]
                if counts[x] * x <= left:
                    stack.append((i - 1, left - counts[x] * x, taken + (x,) * counts[x]))
        found += sorted(level, key=len)
        if len(found) >= limit:
            break
    return found


class _Rest:
    """Items that are left, with the sizes in ascending order; changes are undone in reverse."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts, self.asc = dict(counts), sorted(counts)

    def change(self, x: int, by: int) -> None:
        now = self.counts.get(x, 0) + by
        at = bisect_left(self.asc, x)
        there = at < len(self.asc) and self.asc[at] == x
        if now:
            self.counts[x] = now
            if not there:
                self.asc.insert(at, x)
        else:
            self.counts.pop(x, None)
            if there:
                self.asc.pop(at)

    def completions(self, capacity: int, most: int) -> list[Pattern]:
        """Bins around the largest item that leave at most ``most``."""
        big = self.asc[-1]
        self.change(big, -1)
        out = [(big, *f) for f in fillings(self.asc, self.counts, capacity - big, FILLINGS, most)]
        self.change(big, 1)
        return out


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> Packing:
    """The fewest bins found for items given as ``{length: count}``.

    Best-fit decreasing gives the first incumbent. If the lower bound does
    not prove it optimal, bins are completed around the largest item left,
    depth first: each undominated filling is applied as often as its items
    allow (or once, while few items are left), branches whose waste so far
    rules out fewer bins than the incumbent are cut, and best fit on what is
    left gives further incumbents.
    """
    counts = {x: c for x, c in counts.items() if c}
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    bound, total = lower_bound(counts, capacity), sum(x * c for x, c in counts.items())
    if size <= bound:
        return best
    rest, made, bins, waste = _Rest(counts), [], 0, 0
    open_ = [iter(rest.completions(capacity, (size - 1) * capacity - total))]
    visited = 0
    while open_:
        pattern = next(open_[-1], None)
        if pattern is None or visited >= nodes:
            open_.pop()
            if visited >= nodes or not made:
                break
            pattern, times = made.pop()
            for x in pattern:
                rest.change(x, times)
            bins, waste = bins - times, waste - times * (capacity - sum(pattern))
            continue
        visited += 1
        need = Counter(pattern)
        times = min(rest.counts[x] // k for x, k in need.items())
        lost = capacity - sum(pattern)
        if lost:  # wasteful bins are not repeated blindly
            times = max(1, min(times, times // 2))
        if waste + times * lost > (size - 1) * capacity - total:
            continue
        for x, k in need.items():
            rest.change(x, -k * times)
        made.append((pattern, times))
        bins, waste = bins + times, waste + times * lost
        tail = best_fit(rest.counts, capacity) if visited % 16 == 0 and rest.asc else []
        if not rest.asc or tail:
            now = bins + sum(n for _, n in tail)
            if now < size:
                best, size = made + tail, now
                if size <= bound:
                    return best
        open_.append(iter(rest.completions(capacity, (size - 1) * capacity - total - waste) if rest.asc else []))
    return best


# --- the distributed part ----------------------------------------------------

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def _cut(batches: Iterator[pa.RecordBatch], vocab: str, capacity: int) -> Iterator[pa.RecordBatch]:
    claim("pack")
    bpe, schema = WordBpe.of(vocab), pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        rows = []
        for doc_id, row, text in zip(*map(values, batch.columns), strict=True):
            ids = bpe.ids(text or "") + END_ID
            for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append((doc_id, row, i, at // 4, len(part) // 4, zlib.crc32(part)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 6, schema, strict=True)], schema=schema)


def cut(docs: DataFrame, vocab: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every text once and cut it into pieces; only lengths and checksums leave the worker."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _cut(batches, vocab, capacity), PIECES)


def pack(docs: DataFrame, vocab: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Documents longer than ``capacity`` tokens (with the end id) are cut into
    pieces of ``capacity``; no other is cut. The histogram of lengths (at
    most ``capacity`` rows) goes to the driver, the packing comes back as
    slots: for each length, ranges of ranks with a first sequence and an
    offset. A piece's rank within its length comes from salted buckets, so a
    length that holds a third of all pieces is numbered by many tasks.

    Null texts count as empty and become the end id alone. Null and repeated
    ids are packed like others, one piece for each row. Other columns are not
    read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = stage(cut(docs, vocab, capacity, id_col, text_col), "pack-pieces").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    counted = stage(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    starts = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence, used = [], 0, Counter()
    for pattern, times in bin_completion(counts, capacity):
        offset = 0
        for x in pattern:
            slots.append((x, used[x], used[x] + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    table = spark.createDataFrame(slots, "length long, low long, high long, first_sequence long, offset long")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1
    ranked = pieces.withColumn("inside", rank).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside"))
    # at most a few slots per length: the table grows with capacity, not with the corpus
    by_length = table.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first_sequence", "offset"))).alias("slots"))
    ranked = ranked.join(F.broadcast(by_length), "length")
    slot = F.filter("slots", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") < s["high"]))[0]
    placed = ranked.withColumn("slot", slot)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.low")).alias("sequence_id"), F.col("slot.offset").alias("offset"))
