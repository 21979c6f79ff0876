"""Removal of repeated 100-byte strings with run-length compressed Burrows-Wheeler indexes.

**Dealing.**  Of the hashes of all ``GRAM``-byte strings inside a window of ``LENGTH`` bytes the smallest is the
window's anchor, so equal windows have equal anchors wherever they stand.  Consecutive windows with one
anchor form a stretch; a document is cut into stretches, each window lying in exactly one.  Stretches are
shuffled by anchor, as hashes without their text.  Equal stretches are reduced to the first already in the
map tasks.  An anchor alone in the corpus is done with.  Anchors that hold more than a set share of all
stretches are found first, from counts that add up locally; their stretches are cut further, into single
windows dealt by the window's own hash, so a passage in a third of all documents fills no task.

**Index.**  Where different stretches share an anchor, only an index can tell which windows repeat.  Their
texts are fetched and taken by groups of anchors, in rounds.  The index of a round holds the first texts of
each anchor that are left: suffixes are sorted, the transform is cut into runs of one symbol, and each run
keeps the text positions of its two ends and the row that it maps to.  The later texts are streamed through
it from their ends, all in step, to get their matching statistics up to ``LENGTH``: where a byte extends the match,
its run leads to the next row; where it does not, the match is anchored anew at the nearest run of that byte
above or below, whichever end matches longer.  Windows that match start earlier; what does not match
goes on to the next round, whose index holds four times as many texts of an anchor, and a text that has nothing left, or
no other beside it, is never indexed.  No index exceeds ``INDEX_BYTES`` unless one text does.

**Removal.**  Marked windows return to their documents as ranges, where covered bytes are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import arrow_bytes, share, shared
from tagloom.sources.staging import stage

LENGTH = 100
GRAM = 24
#: Hashes of grams in a window.
SPAN = LENGTH - GRAM + 1
#: Bytes cut at a time, and bytes in one index.
CUT_BYTES = 1 << 20
INDEX_BYTES = 2 << 20
#: Bytes that two texts are compared in at a time.
BLOCK = 8
#: Where a null id stands in the order of documents.
LAST_ID = 2**63 - 1

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Roller:
    """Hashes of any substring from prefix sums, modulo 2**64."""

    def __init__(self, size: int = CUT_BYTES + 2 * LENGTH):
        self.bytes = np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        inverse = pow(_BASE, -1, 2**64)
        ones = np.ones(size + 1, np.uint64)
        ones[1:] = np.uint64(_BASE)
        self.powers = np.multiply.accumulate(ones)
        ones[1:] = np.uint64(inverse)
        self.inverses = np.multiply.accumulate(ones)

    def sums(self, text: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.bytes[text] * self.powers[: len(text)], out=sums[1:])
        return sums

    def hashes(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[begin]) * self.inverses[begin])

    def every(self, sums: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes."""
        n = len(sums) - size
        return _mix((sums[size:] - sums[:n]) * self.inverses[:n])


def smallest(values: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` consecutive values."""
    size = 1
    while 2 * size <= span:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - span + size], values[span - size :]) if span > size else values


def segments(texts: Iterator[bytes]) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """Texts in portions of about ``CUT_BYTES``: ``(document, offset)`` of each part, bytes, part ends.

    A text that is longer than a portion is continued in the next one with ``LENGTH - 1`` bytes again.
    """
    parts: list[tuple[int, int]] = []
    held: list[bytes] = []
    filled = 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at >= LENGTH:
            piece = text[at : at + CUT_BYTES - filled + LENGTH]
            if len(piece) >= LENGTH:
                parts.append((i, at))
                held.append(piece)
                filled += len(piece)
                at += len(piece) - LENGTH + 1
            if filled >= CUT_BYTES - LENGTH:
                yield parts, b"".join(held), np.cumsum([len(h) for h in held])
                parts, held, filled = [], [], 0
    if held:
        yield parts, b"".join(held), np.cumsum([len(h) for h in held])


def stretches(roller: Roller, text: bytes, ends: np.ndarray):
    """``(anchor, begin, windows, sums, part, loops)`` of all stretches; none crosses a part's end.

    ``loops`` marks those that may hold a window twice, as in periodic text: their anchor stands in two
    neighbouring places.
    """
    raw = np.frombuffer(text, np.uint8)
    sums = roller.sums(raw)
    grams = roller.every(sums, GRAM)
    anchors = smallest(grams, SPAN)
    # A gram is the anchor of some window if it equals the largest of the minima around it.
    around = np.concatenate([np.zeros(SPAN - 1, np.uint64), anchors, np.zeros(SPAN - 1, np.uint64)])
    places = grams[grams == ~smallest(~around, SPAN)]
    twice = np.unique(places[1:][places[1:] == places[:-1]])
    part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(anchors)]
    inside = np.arange(len(anchors)) + LENGTH <= ends[part]
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (part[1:] != part[:-1])
    # A stretch in periodic text may be long: cut it into portions of as many windows as an anchor serves.
    begin = np.flatnonzero(new)
    age = np.arange(len(anchors)) - np.repeat(begin, np.diff(begin, append=len(anchors)))
    new |= age % SPAN == 0
    new &= inside
    begin = np.flatnonzero(new)
    covered = np.concatenate([[0], np.cumsum(inside)])
    stop = np.append(begin[1:], len(anchors))
    anchor = anchors[begin]
    loops = np.isin(anchor, twice) if len(twice) else np.zeros(len(anchor), bool)
    return anchor, begin, covered[stop] - covered[begin], sums, part[begin], loops


def anchors_alone(roller: Roller, text: bytes, ends: np.ndarray) -> np.ndarray:
    """The anchors of ``stretches``, one for each change, without what else a cut needs."""
    anchors = smallest(roller.every(roller.sums(np.frombuffer(text, np.uint8)), GRAM), SPAN)
    new = np.ones(len(anchors), bool)
    new[1:] = anchors[1:] != anchors[:-1]
    for end in ends.tolist():  # no window begins here; the next text has its own first stretch
        new[end - LENGTH + 1 : end] = False
        new[end : end + 1] = True
    return anchors[new]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def frequent_anchors(docs: DataFrame, share_of_all: float) -> np.ndarray:
    """Anchors of at least ``2 * share_of_all`` of all stretches, and none of less than ``share_of_all``.

    A task reports the anchors with a ``share_of_all`` of its own stretches.  One that has twice that of
    all stretches keeps at least ``share_of_all`` in the sum of these reports.  At most
    ``1 / share_of_all`` anchors reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in batches:
            found = [
                anchors_alone(roller, text, ends)
                for _, text, ends in segments(arrow_bytes(batch.column(0)))
            ]
            if found:
                anchors, n = np.unique(np.concatenate(found), return_counts=True)
                often = n >= max(2, share_of_all * n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(anchors[often].view(np.int64), 0)),
                        pa.array(np.append(n[often], n.sum())),
                        pa.array(np.append(np.ones(often.sum(), bool), False)),
                    ],
                    ["anchor", "n", "one"],
                )

    counts = docs.select("text").mapInArrow(count, "anchor long, n long, one boolean")
    counts = stage(
        counts.groupBy("one", "anchor").agg(F.sum("n").alias("n")), "anchor_counts"
    )
    total = counts.filter("NOT one").agg(F.sum("n")).head()[0] or 0
    often = counts.filter(F.col("one") & (F.col("n") >= max(2, share_of_all * total)))
    return np.sort(np.array([r["anchor"] for r in often.toLocalIterator()], np.int64)).view(np.uint64)


DEALT = (
    "known boolean, route long, anchor long, content long, doc long, tie long, start long,"
    " windows long, loops boolean"
)


def dealt_stretches(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``DEALT`` rows of all stretches of ``docs (doc, tie, text)``, reduced within each batch.

    ``known`` rows repeat an earlier stretch of their own batch: they are dealt by document.
    """
    box = share(docs.sparkSession, np.sort(frequent))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, often = Roller(), shared(box)
        for batch in batches:
            docs_, ties = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            rows = []
            for parts, text, ends in segments(arrow_bytes(batch.column("text"))):
                anchor, begin, windows, sums, part, loops = stretches(roller, text, ends)
                split = np.isin(anchor, often) if len(often) else np.zeros(len(anchor), bool)
                if split.any():
                    # Single windows, under their own hashes.
                    n = windows[split]
                    single = np.repeat(begin[split] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    part = np.append(part[~split], np.repeat(part[split], n))
                    hash_ = roller.hashes(sums, single, single + LENGTH)
                    anchor = np.append(anchor[~split], _mix(hash_ + np.uint64(1)))
                    begin = np.append(begin[~split], single)
                    windows = np.append(windows[~split], np.ones(n.sum(), np.int64))
                    loops = np.append(loops[~split], np.zeros(n.sum(), bool))
                content = roller.hashes(sums, begin, begin + windows + (LENGTH - 1))
                owner, offset = np.array(parts)[part].T
                first = np.concatenate([[0], ends[:-1]])[part]
                rows.append((anchor, content, owner, begin - first + offset, windows, loops))
            if not rows:
                continue
            anchor, content, owner, start, windows, loops = (
                np.concatenate(c) for c in zip(*rows)
            )
            doc, tie = docs_[owner], ties[owner]
            order = np.lexsort((start, tie, doc, windows, content, anchor))
            anchor, content, doc, tie, start, windows, loops = (
                x[order] for x in (anchor, content, doc, tie, start, windows, loops)
            )
            again = repeated(anchor, content, windows, doc, tie, start)
            route = np.where(again, _mix(doc.view(np.uint64)), _mix(anchor))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(again),
                    _signed(route),
                    _signed(anchor),
                    _signed(content),
                    *(pa.array(x.astype(np.int64)) for x in (doc, tie, start, windows)),
                    pa.array(loops),
                ],
                ["known", "route", "anchor", "content", "doc", "tie", "start", "windows", "loops"],
            )

    return docs.select("doc", "tie", "text").mapInArrow(cut, DEALT)


def repeated(anchor, content, windows, doc, tie, start) -> np.ndarray:
    """Which of the sorted rows come after the first place of equal stretches."""
    same = np.zeros(len(anchor), bool)
    same[1:] = (
        (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (windows[1:] == windows[:-1])
    )
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(anchor))))
    # A repeated row stands at the same place and is no later occurrence.
    return same & ((doc != doc[first]) | (tie != tie[first]) | (start != start[first]))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int = 0, weight: str | None = None):
    """Tables that hold all rows of each ``key`` in sorted batches, of at least ``least`` bytes."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(key).to_numpy()
        last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and keys[0] != keys[-1] else 0
        if last and (weight is None or held.column(weight).nbytes >= least):
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


MARKED = "anchor long, doc long, tie long, start long, windows long, loops boolean, open boolean"


def sorted_out(dealt: DataFrame) -> DataFrame:
    """``MARKED``: repeats of stretches, and with ``open`` the first ones that share an anchor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(table):
            return (table.column(c).to_numpy() for c in names)

        names = ["known", "anchor", "content", "doc", "tie", "start", "windows", "loops"]
        for table in whole_groups(batches, "anchor"):
            known, anchor, content, doc, tie, start, windows, loops = columns(table)
            gone = repeated(anchor, content, windows, doc, tie, start)
            new = np.ones(len(anchor), bool)
            new[1:] = (
                (anchor[1:] != anchor[:-1])
                | (content[1:] != content[:-1])
                | (windows[1:] != windows[:-1])
            )
            group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
            open_ = new & ~known & ((np.bincount(group, new & ~known)[group] > 1) | loops)
            gone = known | gone
            keep = gone | open_
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[keep]) for x in (anchor, doc, tie, start, windows, loops, open_ & ~gone)],
                ["anchor", "doc", "tie", "start", "windows", "loops", "open"],
            )

    rows = dealt.repartition("route").sortWithinPartitions(
        "known", "anchor", "content", "windows", "doc", "tie", "start"
    )
    return rows.mapInArrow(scan, MARKED)


def ordered(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, rank)`` of keys from 0 to ``limit - 1``: equal keys keep their order and share a rank.

    Where a key and its place fit into one word, sorting these words replaces a slower indirect sort.
    """
    bits = len(keys).bit_length()
    if limit << bits < 2**63:
        words = np.sort(keys << bits | np.arange(len(keys)))
        order, found = words & ((1 << bits) - 1), words >> bits
    else:
        order = np.argsort(keys, kind="stable")
        found = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.append(False, found[1:] != found[:-1]))
    return order, rank


def packed(text: bytes) -> np.ndarray:
    """The ``BLOCK`` bytes from each place on as one word, the first one lowest; zeros follow the text."""
    raw = np.frombuffer(text + bytes(BLOCK), np.uint8).astype(np.uint64)
    words = np.zeros(len(text) + 1, np.uint64)
    for i in range(BLOCK):
        words |= raw[i : i + len(words)] << np.uint64(8 * i)
    return words


class RunIndex:
    """A Burrows-Wheeler transform of several texts in runs, with what streaming through it needs."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts])
        n = int(sizes.sum())
        #: Where each text begins, and where its end mark stands.
        self.stops = np.cumsum(sizes) - 1
        self.begins = self.stops - sizes + 1
        symbols = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[self.stops] = False
        symbols[inner] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        end = np.repeat(self.stops, sizes)
        at = np.arange(n)
        key = np.zeros(n, np.int64)
        for i in range(7):
            place = at + i
            key = key * 257 + np.where(place <= end, symbols[np.minimum(place, n - 1)], 0)
        depth, half = 7, None
        order, rank = ordered(key, 257**7)
        while True:
            if depth == 56:
                half = rank
            if depth > sizes.max() or (rank[order[-1]] == n - 1 and half is not None):
                break
            place = at + depth
            key = rank * (n + 1) + np.where(place <= end, rank[np.minimum(place, n - 1)] + 1, 0)
            depth *= 2
            # Texts that are equal to their end keep their order.
            order, rank = ordered(key, n * (n + 1))
        row_of = np.empty(n, np.int64)
        row_of[order] = at
        # Rows of one class share their first LENGTH bytes; each class knows its earliest text position.
        new_class = np.ones(n, bool)
        if half is not None:
            whole = order + LENGTH <= end[order]
            far = half[np.minimum(order + LENGTH - 56, n - 1)]
            new_class[1:] = ~(
                whole[1:] & whole[:-1] & (half[order][1:] == half[order][:-1]) & (far[1:] == far[:-1])
            )
        self.classes = np.flatnonzero(new_class)
        self.earliest = np.minimum.reduceat(order, self.classes)
        # Runs of the symbol before each suffix, in suffix order; rows of a run map to rows in a row.
        before = symbols[order - 1]
        self.starts = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.ends = np.append(self.starts[1:], n) - 1
        self.symbol = before[self.starts]
        self.first, self.last = order[self.starts], order[self.ends]
        self.maps_to = row_of[self.first - 1]
        self.end_rows = row_of[self.stops]
        runs = len(self.starts)
        #: The run of each row, instead of a search among the starts.
        self.run_of = np.repeat(np.arange(runs, dtype=np.int32), self.ends - self.starts + 1)
        self.by_symbol = np.sort(self.symbol * runs + np.arange(runs))
        self.words = packed(b"\0".join(texts))

    def common(self, words: np.ndarray, place: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many bytes, up to ``limit``, the queries from ``place`` share with the texts from ``at``.

        ``words`` are the queries, packed.
        """
        limit = np.minimum(limit, self.stops[np.searchsorted(self.stops, at)] - at)
        found = np.zeros(len(place), np.int64)
        left = np.flatnonzero(limit > 0)
        while len(left):
            done = found[left]
            other = words[place[left] + done] ^ self.words[at[left] + done]
            # The lowest bit that differs tells how many of the bytes, from the first on, do not.
            lowest = (other & (~other + np.uint64(1))).astype(float)
            same = np.where(other == 0, BLOCK, (np.frexp(lowest)[1] - 1) // 8)
            found[left] = np.minimum(done + same, limit[left])
            left = left[(same == BLOCK) & (found[left] < limit[left])]
        return found

    def anchored(self, words, symbol, run, place, length):
        """``(run, row, length)`` of the longest match before ``symbol`` among the nearest runs of it.

        ``length`` is -1 where the index does not hold the symbol.
        """
        runs = len(self.starts)
        k = np.searchsorted(self.by_symbol, symbol * runs + run)
        below, above = self.by_symbol[np.minimum(k, runs - 1)], self.by_symbol[np.maximum(k - 1, 0)]
        best = np.full(len(run), -1)
        out_run, out_row = np.zeros(len(run), np.int64), np.zeros(len(run), np.int64)
        for near, real, sample, row in (
            (above, k > 0, self.last, self.ends),
            (below, k < runs, self.first, self.starts),
        ):
            real = np.flatnonzero(real & (near // runs == symbol))
            other = near[real] % runs
            shared = self.common(words, place[real] + 1, sample[other], length[real])
            longer = shared > best[real]
            real, other = real[longer], other[longer]
            best[real], out_run[real], out_row[real] = shared[longer], other, row[other]
        return out_run, out_row, best

    def stream(
        self, texts: list[bytes], member: np.ndarray | None = None, least: int = 0
    ) -> tuple[np.ndarray, np.ndarray]:
        """``(length, begins)``: at each byte of ``texts``, one after the other, how long the match is.

        Lengths are matching statistics up to ``LENGTH``: the longest string from the byte on that the index
        holds too.  A text that is the indexed text ``member`` matches itself; there lengths of ``LENGTH`` count
        only where these bytes have an earlier place in the index, and are 0 elsewhere.  Where no match of
        ``least`` bytes can come any more, a text is given up, and its lengths before that are 0.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        stops = np.cumsum(sizes)
        begins = stops - sizes
        raw = b"".join(texts)
        words, queries = packed(raw), np.frombuffer(raw, np.uint8)
        lengths = np.zeros(len(raw), np.int64)
        who = np.arange(len(texts))
        place, left = stops.copy(), sizes.copy()
        rows = np.zeros(len(texts), np.int64) if member is None else self.end_rows[member]
        length = np.zeros(len(texts), np.int64)
        while True:
            alive = (left > 0) & (length + left >= least)
            n = np.count_nonzero(alive)
            if not n:
                return lengths, begins
            if n < 0.8 * len(alive):  # the others are carried along until they are many
                who, place, left, rows, length = (x[alive] for x in (who, place, left, rows, length))
                alive = np.ones(n, bool)
            place, left = np.maximum(place - 1, 0), left - 1
            symbol = queries[place].astype(np.int64) + 1
            run = self.run_of[rows]
            off = np.flatnonzero(alive & (self.symbol[run] != symbol))
            if len(off):
                run[off], rows[off], length[off] = self.anchored(
                    words, symbol[off], run[off], place[off], length[off]
                )
            rows = np.where(length < 0, 0, self.maps_to[run] + rows - self.starts[run])
            length = np.minimum(length + 1, LENGTH)
            lengths[place[alive]] = length[alive]
            if member is not None:
                full = np.flatnonzero(alive & (length >= LENGTH))
                first = self.earliest[np.searchsorted(self.classes, rows[full], "right") - 1]
                own = self.begins[member[who[full]]] + place[full] - begins[who[full]]
                lengths[place[full[first >= own]]] = 0


def ranges_of(marks: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, offset, size)`` of the runs of true marks in texts that lie one after the other."""
    edge = np.diff(np.concatenate([[0], marks.view(np.int8), [0]]))
    # A run ends with its text.
    new = np.zeros(len(marks) + 1, bool)
    new[begins] = True
    cuts = np.flatnonzero(new[1:-1] & marks[1:] & marks[:-1]) + 1
    begin = np.sort(np.append(np.flatnonzero(edge == 1), cuts))
    stop = np.sort(np.append(np.flatnonzero(edge == -1), cuts))
    owner = np.searchsorted(begins, begin, "right") - 1
    return owner, begin - begins[owner], stop - begin


def later_windows(
    anchor: np.ndarray, loops: np.ndarray, texts: list[bytes], index_bytes: int
) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, offset, windows)`` of all windows of ``texts`` that start earlier in texts of their anchor.

    Texts are sorted by anchor and place; only one with ``loops`` may hold a window twice.
    """
    group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1]))
    owner, offset, parts = np.arange(len(texts)), np.zeros(len(texts), np.int64), list(texts)
    answers, take = [], 1
    while True:
        # What has no other text of its anchor beside it can only repeat itself.
        whose = group[owner]
        new_text = np.append(True, owner[1:] != owner[:-1])
        first = np.append(True, whose[1:] != whose[:-1])
        rank = np.cumsum(new_text)
        rank -= np.maximum.accumulate(np.where(first, rank, 0))
        several = np.bincount(whose, new_text, minlength=group[-1] + 1)[whose] > 1
        keep = np.flatnonzero(several | loops[owner])
        if not len(keep):
            return answers
        owner, offset, rank, whose = owner[keep], offset[keep], rank[keep], whose[keep]
        parts = [parts[i] for i in keep]
        # The first texts of each anchor, as far as they fit; of an anchor no text before an earlier one.
        by_rank = np.argsort(rank, kind="stable")
        filled = np.cumsum([len(parts[i]) for i in by_rank])
        room = np.searchsorted(filled, index_bytes, "right")
        last = max(1, min(np.searchsorted(rank[by_rank], take), room))
        # All parts of a text go together.
        while last < len(by_rank) and owner[by_rank[last]] == owner[by_rank[last - 1]]:
            last += 1
        inside = np.zeros(len(parts), bool)
        inside[by_rank[:last]] = True
        held = np.flatnonzero(inside)
        index = RunIndex([parts[i] for i in held])
        own = np.flatnonzero((rank[held] > 0) | loops[owner[held]])
        for chosen, member in ((held[own], own), (np.flatnonzero(~inside), None)):
            if not len(chosen):
                continue
            lengths, begins = index.stream([parts[i] for i in chosen], member, LENGTH)
            text, at, size = ranges_of(lengths >= LENGTH, begins)
            answers.append((owner[chosen[text]], offset[chosen[text]] + at, size))
        if inside.all():
            return answers
        # Windows that found no match, with their bytes.
        short = lengths < LENGTH
        for i in range(1, LENGTH):
            short[np.append(begins[1:], len(short)) - i] = False
        text, at, size = ranges_of(short, begins)
        parts = [parts[chosen[t]][a : a + n + LENGTH - 1] for t, a, n in zip(text, at, size)]
        owner, offset = owner[chosen[text]], offset[chosen[text]] + at
        if not parts:
            return answers
        take *= 4


RANGES = "doc long, tie long, start long, windows long"


def matched_windows(fetched: DataFrame) -> DataFrame:
    """``RANGES`` of windows in ``fetched (anchor, doc, tie, start, loops, text)`` that also start earlier."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "anchor", INDEX_BYTES, "text"):
            anchor, doc, tie, start, loops = (
                table.column(c).to_numpy() for c in ("anchor", "doc", "tie", "start", "loops")
            )
            texts = table.column("text").to_pylist()
            for owner, offset, windows in later_windows(anchor, loops, texts, INDEX_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[owner]), pa.array(tie[owner]), pa.array(start[owner] + offset), pa.array(windows)],
                    ["doc", "tie", "start", "windows"],
                )

    rows = fetched.repartition("anchor").sortWithinPartitions("anchor", "doc", "tie", "start")
    return rows.mapInArrow(search, RANGES)


def fetch_texts(own: DataFrame, marked: DataFrame) -> DataFrame:
    """The bytes of ``open`` stretches from their documents."""
    wanted = (
        marked.filter("open")
        .groupBy("doc", "tie")
        .agg(F.collect_list(F.struct("anchor", "start", "windows", "loops")).alias("places"))
    )
    # Repeated rows of one id and text are one document.
    joined = own.dropDuplicates(["doc", "tie"]) if own_repeats(own) else own
    joined = joined.join(wanted, ["doc", "tie"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py().encode()
                doc, tie = batch.column("doc")[k].as_py(), batch.column("tie")[k].as_py()
                places = batch.column("places")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p["anchor"] for p in places], pa.int64()),
                        pa.array([doc] * len(places), pa.int64()),
                        pa.array([tie] * len(places), pa.int64()),
                        pa.array([p["start"] for p in places], pa.int64()),
                        pa.array([p["loops"] for p in places], pa.bool_()),
                        pa.array(
                            [
                                text[p["start"] : p["start"] + p["windows"] + LENGTH - 1]
                                for p in places
                            ],
                            pa.binary(),
                        ),
                    ],
                    ["anchor", "doc", "tie", "start", "loops", "text"],
                )

    return joined.select("doc", "tie", "text", "places").mapInArrow(
        fetch, "anchor long, doc long, tie long, start long, loops boolean, text binary"
    )


def own_repeats(own: DataFrame) -> bool:
    """Whether any id stands on several rows; reads ids only."""
    counts = own.select("doc").groupBy("doc").count()
    return not counts.filter("count > 1").isEmpty()


def kept_bytes(text: bytes, starts: list[int], windows: list[int]) -> tuple[bytes, int]:
    """What is left of ``text`` without the windows, and the number of maximal removed runs."""
    if not starts:
        return text, 0
    edge = np.zeros(len(text) + 1, np.int64)
    begin, n = np.array(starts), np.array(windows)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n + LENGTH - 1, -1)
    gone = np.cumsum(edge)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), spans


KEPT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def remove_repeats(docs: DataFrame, with_bytes: bool = True) -> DataFrame:
    """``KEPT`` of every row: its bytes without those that a ``LENGTH``-byte string covers which also
    starts earlier, in a smaller id or earlier in the same document.

    A null text is empty.  Null ids come last; texts that share an id are ordered by a hash of the text and
    are documents of their own, rows that repeat an id and its text are one document.  Texts under
    ``LENGTH`` bytes stay.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    id_or_last = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    plain = docs.select(id_or_last.alias("doc"), F.col("doc_id").isNull().alias("no_id"), "text")
    text_hash = F.xxhash64("text")
    tie = text_hash if own_repeats(plain) else F.lit(0).cast("long")
    own = plain.select("doc", "no_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", tie)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_anchors(own, 1 / (4 * partitions))
    marked = stage(sorted_out(dealt_stretches(own, frequent)), "stretches")
    ranges = marked.filter("NOT open").select("doc", "tie", "start", "windows")
    ranges = ranges.unionByName(matched_windows(fetch_texts(own, marked)))
    by_doc = ranges.groupBy("doc", "tie").agg(
        F.collect_list("start").alias("starts"), F.collect_list("windows").alias("windows")
    )
    joined = own.join(by_doc, ["doc", "tie"], "left").select(
        "doc", "no_id", "text", "starts", "windows"
    )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for k, text in enumerate(arrow_bytes(part.column("text"))):
                    starts = part.column("starts")[k].as_py() or []
                    left, spans = kept_bytes(text, starts, part.column("windows")[k].as_py() or [])
                    no_id = part.column("no_id")[k].as_py()
                    rows.append(
                        (
                            None if no_id else part.column("doc")[k].as_py(),
                            len(text),
                            len(text) - len(left),
                            spans,
                            left if with_bytes else None,
                            hashlib.sha256(left).hexdigest(),
                        )
                    )
                kinds = [*[pa.int64()] * 4, pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], KEPT.names
                )

    return joined.mapInArrow(finish, KEPT)


def repeat_report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    return remove_repeats(docs, with_bytes=False).drop("kept")
