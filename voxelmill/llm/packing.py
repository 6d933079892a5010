"""Best-fit packing by bin completion (operator 3).

Only lengths matter to a packing, and there are at most ``room`` different ones, however large the
corpus. So the plan is made for the counts of lengths: a list of fillings, each with the number of
sequences that take it. Spark counts lengths, numbers the pieces of each length without gaps and looks up each piece's
place in the plan; no group of pieces is ever held in one place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise, number_rows, partitions, slices, table
from .tokens import encoder

ROOM, END_OF_TEXT = 4096, 1
#: Nodes of the search after the first solution, fillings kept around one document, and the lengths and pieces tried by a full enumeration of them.
NODES, FILLINGS, FEW, STEPS = 1000, 12, 24, 3000
#: Fillings are compared up to this product of their numbers of pieces; beyond it both stay, which costs steps only.
COMPARED = 1 << 12


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b can be dealt out into the places of a."""
    room = sorted(a)
    for x in sorted(b, reverse=True):
        at = next((k for k, r in enumerate(room) if r >= x), None)
        if at is None:
            return False
        room[at] -= x
        room.sort()
    return True


def _all(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, ...]] | None:
    """All fillings that no piece left fits into any more; None if there are more than FEW lengths or STEPS to try."""
    if len(lengths) > FEW:
        return None
    found: list[tuple[int, ...]] = []
    steps = 0

    def extend(chosen: tuple[int, ...], left: int, k: int, skipped: int) -> bool:
        nonlocal steps
        steps += 1
        if steps > STEPS:
            return False
        while k >= 0 and lengths[k] > left:
            k -= 1
        if k < 0:
            if left < skipped:  # else the shortest piece passed over would still fit
                found.append(chosen)
            return True
        x = lengths[k]
        most = min(left // x, counts[x])
        return all(extend(chosen + (x,) * n, left - x * n, k - 1, skipped if n == counts[x] else min(skipped, x)) for n in range(most, -1, -1))

    return found if extend((), room, len(lengths) - 1, room + 1) else None


def _ends(x: np.ndarray, n: np.ndarray, left: int, most: int) -> list[tuple[int, ...]]:
    """Of the fillings by one, two or three pieces (three only where two leave waste) those of least waste: all lengths are tried, at once."""
    k = int(np.searchsorted(x, left, side="right"))
    if not k:
        return [()]
    found = [(int(x[k - 1]),)]

    def pairs(x: np.ndarray, n: np.ndarray, left: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second piece (not longer than the first) and waste."""
        first = x[: int(np.searchsorted(x, left, side="right"))]
        at = np.minimum(np.searchsorted(x, left - first, side="right") - 1, np.arange(len(first)))
        at -= (at == np.arange(len(first))) & (n[: len(first)] < 2)
        ok = at >= 0
        first, second = first[ok], x[at[ok]]
        return first, second, left - first - second

    a, b, waste = pairs(x[:k], n[:k], left)
    best = np.lexsort((-a, waste))[:most]
    found += [(int(a[j]), int(b[j])) for j in best]
    if not len(waste) or waste.min() > 0:
        for j in range(k - 1, max(-1, k - 1 - most), -1):
            rest = n[: j + 1].copy()
            rest[j] -= 1
            top = j + 1 if rest[j] else j
            a, b, waste = pairs(x[:top], rest[:top], left - int(x[j]))
            if len(waste):
                at = int(waste.argmin())
                found.append((int(x[j]), int(a[at]), int(b[at])))
    return found


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of the room by available lengths (ascending list), those of least waste first, ``most`` at most.

    All of them, if FEW lengths and STEPS pieces suffice to enumerate them. Else the first pieces are the longest that fit, with their multiplicity, and the last two or three
    are chosen among all lengths for the least waste, from the last step back; nothing that is left fits any more.
    """
    found = _all(lengths, counts, room)
    if found is None:
        found, chosen, left, top, steps = [], (), room, room, []
        while (k := bisect_right(lengths, min(left, top)) - 1) >= 0:
            x = lengths[k]
            n = min(left // x, counts[x])
            steps += [(chosen + (x,) * m, left - m * x) for m in range(max(0, n - 2), n)]
            chosen, left, top = chosen + (x,) * n, left - n * x, x - 1
        found.append(chosen)
        full = np.array(lengths, np.int64)
        have = np.array([counts[x] for x in lengths], np.int64)
        for chosen, left in reversed(steps):
            n = have.copy()
            for x, m in Counter(chosen).items():
                n[bisect_right(lengths, x) - 1] -= m
            some = n > 0
            found += [tuple(sorted(chosen + end, reverse=True)) for end in _ends(full[some], n[some], left, 4)]
            if sum(sum(f) == room for f in found) >= most:
                break
        found = [_complete(f, lengths, counts, room) for f in found]
    found = sorted(set(found), key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    out: list[tuple[int, ...]] = []
    for f in found:
        if len(out) < most and not any(sum(o) >= sum(f) and len(o) * len(f) <= COMPARED and _dominates(o, f) for o in out):
            out.append(f)
    return out


def _complete(chosen: tuple[int, ...], lengths: list[int], counts: dict[int, int], room: int) -> tuple[int, ...]:
    """The filling with as many pieces more as fit, longest first."""
    left, taken = room - sum(chosen), Counter(chosen)
    k = bisect_right(lengths, left) - 1
    while k >= 0:
        x = lengths[k]
        n = min(left // x, counts[x] - taken[x])
        chosen, left = chosen + (x,) * n, left - n * x
        k = bisect_right(lengths, min(left, x - 1)) - 1
    return tuple(sorted(chosen, reverse=True))


def lower_bound(counts: dict[int, int], room: int) -> int:
    """Sequences that any packing needs: by total length, and with pieces below each size left out, those over half the room being alone."""
    x = np.array(sorted(counts), np.int64)
    if not len(x):
        return 0
    n = np.array([counts[k] for k in x.tolist()], np.int64)
    best = -(-int(x @ n) // room)
    over = 2 * x > room
    for least in x[~over].tolist():
        lone, mid = over & (x > room - least), ~over & (x >= least)
        pairs = over & ~lone
        spare = int(n[pairs].sum()) * room - int(x[pairs] @ n[pairs])
        best = max(best, int(n[over].sum()) + max(0, -(-(int(x[mid] @ n[mid]) - spare) // room)))
    return best


def plan(counts: dict[int, int], room: int = ROOM, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """(filling, times) pairs that use up all counts in few sequences.

    Bin completion: the largest piece left takes one of the undominated fillings around it, least waste
    first, so that the first descent is a best-fit solution and the incumbent. A branch is cut when the waste so
    far exceeds what a better solution could afford; the search ends at the lower bound or after ``nodes`` steps.
    """
    now = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in now.items())
    bound = lower_bound(now, room)
    best: list | None = None
    best_bins, left = float("inf"), nodes

    def choices(most: int) -> tuple[int, list]:
        top = max(now)
        put((top,), -1)
        found = fillings(sorted(now), now, room - top, most)
        put((top,), 1)
        return top, found

    def put(filling: tuple[int, ...], times: int) -> None:
        """Gives pieces back to the counts, or takes them for negative times."""
        for x, n in Counter(filling).items():
            now[x] = now.get(x, 0) + n * times
            if not now[x]:
                del now[x]

    # Each level: its largest piece and fillings (at first only the best one), how many have been tried, the one taken now, and what its path has used before.
    # Counts are held once; going back undoes what was taken.
    stack: list[list] = [[*choices(1), 0, None, 0, 0]] if now else []
    while stack:
        level = stack[-1]
        top, options, k, taken, used, waste = level
        if taken:
            put(*taken)
            level[3] = None
        if best is not None and left <= 0:
            break
        if k == 1 and len(options) == 1:
            options += [f for f in choices(FILLINGS)[1] if f != options[0]]
        if k >= len(options):
            stack.pop()
            continue
        level[2] += 1
        filling = (top, *options[k])
        times = min(now[x] // n for x, n in Counter(filling).items())
        more = (room - sum(filling)) * times
        if best is not None and waste + more > (best_bins - 1) * room - total:
            continue
        put(filling, -times)
        level[3] = (filling, times)
        left -= best is not None
        if now:
            stack.append([*choices(1), 0, None, used + times, waste + more])
        elif used + times < best_bins:
            best, best_bins = [x[3] for x in stack], used + times
            if best_bins == bound:
                break
    return best or []


def _places(fills: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, pieces of it per sequence and offset, by ascending rank."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for filling, times in fills:
        offset = 0
        for x in dict.fromkeys(filling):
            n = filling.count(x)
            rows.setdefault(x, []).append((ranks.get(x, 0), sequence, n, offset))
            ranks[x] = ranks.get(x, 0) + n * times
            offset += n * x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def pieces(docs: DataFrame, tokenizer: str, spaces: str = "dropped", room: int = ROOM, end: int = END_OF_TEXT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids followed by ``end``, cut into pieces of ``room``."""
    stop = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(tokenizer, spaces)
        for batch in slices(batches, True):
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found.encode_column(batch.column("text")), strict=True):
                ids += stop
                for k, a in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[a : a + 4 * room]
                    out.append((doc_id, k, k * room, len(part) // 4, zlib.crc32(part)))
            cols = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, room: int = ROOM) -> DataFrame:
    """Adds sequence_id and offset to pieces (length from 1 to ``room``); sequences have no gaps and at most ``room`` tokens.

    The counts of lengths, at most ``room`` rows, go to the driver for the plan. Rows that repeat each other take places of their own.
    """
    cut = materialise(cut, "pieces")
    counts = {int(r.length): int(r.n) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(room, 0)
    fills = [((room,), whole)] if whole else []
    places = _places(fills + plan(counts, room))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, base, n, off = places[int(x)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                past = rank[rows] - first[k]
                sequence[rows] = base[k] + past // n[k]
                offset[rows] = off[k] + past % n[k] * x
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = number_rows(cut, ["length"], ["doc_id", "piece"], F.struct("doc_id", "piece"), partitions(cut.sparkSession), "rank")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Packs whole documents. A null text is empty, so it is one token; a null doc_id and repeated rows are packed like others."""
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
