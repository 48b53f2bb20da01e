"""Benchmark decontamination by q-gram lemma filtering.

Texts are normalised: lower case, everything but letters and digits to single blanks. Benchmark items are cut twice: into
segments of ``SEGMENT`` to twice as many characters (a shorter item is one segment), side by side; and into overlapping segments
of ``WINDOW`` characters, ``STRIDE`` apart, so that a passage of ``WINDOW + STRIDE - 1`` characters or more holds a whole one
wherever it begins. A segment of ``m`` characters may occur with
``e = m * EDIT_PERCENT // 100`` edits; any such occurrence shares ``m - Q + 1 - Q * e`` of its character q-grams or more, all
on diagonals (text position less segment position) within ``e`` of each other. So the scan

1. looks up every q-gram of a text in the benchmark's, and keeps stretches of text with enough hits;
2. counts hits by segment and diagonal band; each band overlaps half of the next, so any ``e`` diagonals lie in one;
3. keeps bands that reach the segment's bound, and verifies them by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q = 8
SEGMENT, EDIT_PERCENT = 100, 8
WINDOW, STRIDE = 50, 10
#: Items with fewer normalised characters have no passage to look for.
LEAST = 24
#: Benchmark text (bytes) that is indexed and broadcast at once; a larger benchmark is scanned in blocks.
BLOCK_BYTES = 16_000_000
#: Characters of text that are scanned at once (a longer text alone).
GROUP = 1 << 18
#: Cells of the alignments that are made at once.
CELLS = 1 << 19

_HASH_BITS = 22
_K = np.uint64(0x9E3779B97F4A7C15)
#: No character: pads regions.
_NOTHING = np.uint32(0xFFFFFFFF)
_TABLE: list[np.ndarray] = []


def _fold() -> np.ndarray:
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        kept = np.array([i for i in range(0x110000) if chr(i).isalnum()], np.uint32)
        table[kept] = kept
        _TABLE.append(table)
    return _TABLE[0]


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised code points of all texts, a blank at the ends of each; where each begins; and each one's place in the
    lower-cased texts laid end to end, a blank before and after every text."""
    codes = [np.frombuffer(f" {x.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4") for x in texts]
    flat = _fold()[np.concatenate(codes)] if codes else np.zeros(0, np.uint32)
    begins = np.cumsum([0, *(len(c) for c in codes)])
    blank = flat == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[begins[:-1]] = True
    places = np.flatnonzero(keep)
    return flat[places], np.searchsorted(places, begins), places


def _bytes(codes: np.ndarray) -> np.ndarray:
    """One byte for each code point; different ones may share it, as what is found is aligned on code points."""
    return (codes ^ codes >> np.uint32(8) ^ codes >> np.uint32(13)).astype(np.uint8)


def _grams(codes: np.ndarray) -> np.ndarray:
    """The q-gram that starts at each character, as a number."""
    raw = np.concatenate([_bytes(codes), np.zeros(8, np.uint8)])
    grams = np.ndarray((max(len(codes) - Q + 1, 0),), "<u8", raw, strides=(1,)).copy()
    return grams if Q == 8 else grams & np.uint64((1 << 8 * Q) - 1)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _K >> np.uint64(64 - _HASH_BITS)).astype(np.int64)


class Index:
    """The q-grams of a block of benchmark items, by place in the items laid end to end; and their segments."""

    def __init__(self, items: list[tuple[int, str]]):
        whole, self.items, begins, sizes, slides = [], [], [], [], []
        base = 0
        for item, text in items:
            codes = normal([text])[0]
            codes = codes[1:-1] if len(codes) > 1 else codes[:0]
            if len(codes) < LEAST:
                continue
            for part in np.array_split(np.arange(len(codes)), max(1, len(codes) // SEGMENT)):
                self.items.append(item)
                begins.append(base + int(part[0]))
                sizes.append(len(part))
            slides.append((item, base, (len(codes) - WINDOW) // STRIDE + 1 if len(codes) > WINDOW else 0))
            whole.append(codes)
            base += len(codes)
        self.long = len(begins)
        self.bases = np.array([x for _, x, _ in slides], np.int64)
        self.windows = np.array([x for _, _, x in slides], np.int64)
        self.window = self.long + np.cumsum(self.windows) - self.windows
        for item, at, count in slides:
            self.items += [item] * count
            begins += range(at, at + count * STRIDE, STRIDE)
            sizes += [WINDOW] * count
        self.codes = np.concatenate(whole) if whole else np.zeros(0, np.uint32)
        self.begin, self.size = np.array(begins, np.int64), np.array(sizes, np.int64)
        self.edits = np.minimum(self.size * EDIT_PERCENT // 100, (self.size - Q) // Q)
        self.bound = self.size - Q + 1 - Q * self.edits
        grams = [_grams(x) for x in whole]
        places = np.concatenate([x + np.arange(len(g)) for x, g in zip(self.bases, grams, strict=True)]) if whole else np.zeros(0, np.int64)
        all_grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(all_grams, kind="stable")
        self.grams, self.first, self.count = np.unique(all_grams[order], return_index=True, return_counts=True)
        self.place = places[order]
        self.reach = int((self.size + 2 * self.edits).max(initial=0))
        self.slots = np.zeros(1 << _HASH_BITS, bool)
        self.slots[_slot(self.grams)] = True

    def _segments(self, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of arrays: which of the places of q-grams lie whole in a segment, and in which one."""
        side = np.searchsorted(self.begin[: self.long], place, "right") - 1
        inside = np.flatnonzero(place + Q <= self.begin[side] + self.size[side])
        yield inside, side[inside]
        item = np.searchsorted(self.bases, place, "right") - 1
        within = place - self.bases[item]
        for back in range(-(-(WINDOW - Q + 1) // STRIDE)):
            k = within // STRIDE - back
            inside = np.flatnonzero((k >= 0) & (k < self.windows[item]) & (within - k * STRIDE <= WINDOW - Q))
            yield inside, (self.window[item] + k)[inside]

    def _hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram is the benchmark's, in stretches with enough of them; and its number."""
        at = np.flatnonzero(self.slots[_slot(grams)])
        number = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        real = self.grams[number] == grams[at]
        at, number = at[real], number[real]
        reach = self.reach
        enough = np.searchsorted(at, at + reach, "left") - np.arange(len(at)) >= self.bound.min()
        edge = np.zeros(len(grams) + reach + 1, np.int32)
        np.add.at(edge, at[enough], 1)
        np.add.at(edge, at[enough] + reach, -1)
        dense = np.cumsum(edge)[at] > 0
        return at[dense], number[dense]

    def scan(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, segment, first and last character, edits, characters of the segment) of segments found in texts.

        Characters count from 0 in the lower-cased text. Of a segment's occurrences in a text, the one with the fewest
        edits is given, of equal ones the first.
        """
        if not len(self.codes):
            return
        codes, begins, places = normal(texts)
        at, number = self._hits(_grams(codes))
        n = self.count[number]
        spread = np.repeat(self.first[number] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place, at = self.place[spread], np.repeat(at, n)
        keys = []
        for inside, segment in self._segments(place):
            diagonal = at[inside] - place[inside] + self.begin[segment]
            band = (diagonal + (1 << 40)) // (self.edits[segment] + 1)
            keys += [segment << 45 | band, segment << 45 | band - 1]
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        segment, band = key >> 45, key & (1 << 45) - 1
        good = count >= self.bound[segment]
        segment, band = segment[good], band[good]
        e, m = self.edits[segment], self.size[segment]
        low = band * (e + 1) - (1 << 40)
        text = np.searchsorted(begins, np.clip(low + e + m // 2, 0, len(codes) - 1), "right") - 1
        left, right = np.maximum(low - e, begins[text]), np.minimum(low + 2 * (e + 1) + m + e, begins[text + 1])
        found: dict[tuple[int, int], tuple] = {}
        for exact in (True, False):
            for size in np.unique(m).tolist():
                same = np.flatnonzero(m == size)
                if not exact:
                    same = np.array([j for j in same.tolist() if (int(text[j]), int(segment[j])) not in best], np.int64)
                step = max(1, CELLS // (3 * size))
                for some in (same[k : k + step] for k in range(0, len(same), step)):
                    budget = int(e[some[0]])
                    wanted = self.codes[self.begin[segment[some]][:, None] + np.arange(size)]
                    length = np.maximum(right[some] - left[some], 0)
                    column = np.arange(int(length.max(initial=0)))
                    region = np.where(column < length[:, None], codes[np.minimum(left[some][:, None] + column, len(codes) - 1)], _NOTHING)
                    edits, first, last = align_equal(wanted, region) if exact else align_all(wanted, region, length, budget)
                    for k in np.flatnonzero(edits <= budget).tolist():
                        j = int(some[k])
                        name, cost, start = (int(text[j]), int(segment[j])), int(edits[k]), int(places[left[j] + first[k]])
                        old = found.get(name)
                        if old is None or (cost, start) < (old[2], old[0]):
                            found[name] = (start, int(places[left[j] + last[k]]), cost)
            best = dict(found)  # nothing has fewer edits than an equal part
        shift = np.cumsum([0, *(len(x.lower()) + 2 for x in texts)])
        for (text, s), (start, stop, edits) in sorted(best.items()):
            yield text, s, start - int(shift[text]) - 1, stop - int(shift[text]) - 1, edits, int(self.size[s])


def align(segment: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn a part of ``region`` into all of ``segment``, with the part's first and last character.

    None if they exceed ``budget``.
    """
    if not len(segment) or len(region) < len(segment) - budget:
        return None
    edits, first, last = align_all(segment[None], region[None], np.array([len(region)]), budget)
    return (int(edits[0]), int(first[0]), int(last[0])) if edits[0] <= budget else None


def align_equal(segments: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``align_all``, for parts equal to the segment: 0 edits, or as many as the segment's characters and one if none is."""
    rows, m = segments.shape
    first = np.full(rows, -1)
    for k in range(regions.shape[1] - m, -1, -1):
        here = np.flatnonzero(regions[:, k] == segments[:, 0])
        first[here[(regions[here, k : k + m] == segments[here]).all(1)]] = k
    return np.where(first < 0, m + 1, 0), first, first + m - 1


def align_all(segments: np.ndarray, regions: np.ndarray, lengths: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: fewest edits (over ``budget`` if there are more), first and last character of the part of its region.

    Regions have ``lengths`` characters each. A row of a table holds the distances for one prefix of the segment; only
    diagonals that the longest region leaves open exist, and they are as many as the band is wide.
    """
    rows, m = segments.shape
    n = lengths[:, None]
    width = max(int(lengths.max(initial=0)) - m, 0) + 2 * budget + 1
    offset = np.arange(width) - budget
    far = np.int32(m + regions.shape[1] + 1)
    flat = np.concatenate([regions, np.full((rows, 1), _NOTHING, regions.dtype)], 1)
    row = np.where((offset >= 0) & (offset <= n), np.int32(0), far)
    start = np.where((offset >= 0) & (offset <= n), offset.astype(np.int32), np.int32(0))
    steps, blank = np.arange(width, dtype=np.int32), np.full((rows, 1), far, np.int32)
    for i in range(1, m + 1):
        column = offset + i
        inside = (column >= 1) & (column <= n)
        same = flat[:, np.clip(column - 1, 0, regions.shape[1])] == segments[:, i - 1 : i]
        across = np.where(inside, row + ~same, far)
        down = np.concatenate([row[:, 1:], blank], 1) + np.int32(1)
        down_start = np.concatenate([start[:, 1:], np.zeros((rows, 1), np.int32)], 1)
        take = down < across
        cost, begin = np.where(take, down, across), np.where(take, down_start, start)
        open_ = (column >= 0) & (column <= n)
        slid = np.where(open_, cost, far) - steps
        lowest = np.minimum.accumulate(slid, 1)
        source = np.maximum.accumulate(np.where(slid == lowest, steps, 0), 1)
        row, start = np.where(open_, lowest + steps, far), np.take_along_axis(begin, source, 1)
    k = row.argmin(1)
    every = np.arange(rows)
    first = start[every, k]
    return row[every, k], first, np.maximum(offset[k] + m - 1, first)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_segments, of_segments, edits, first_char, last_char`` of each benchmark item found in a text.

    An item is found if one of its segments is, side by side or overlapping; all count in ``n_segments``, and ``edits`` adds
    up over the segments found (an edit that overlapping ones share counts in each); the characters span them, in the lower-cased
    text. So an item's passage of 59 normalised characters or more is found wherever it begins. Null and empty texts and items, and items under ``LEAST`` normalised characters, give nothing. Whole
    texts are scanned, however long; equal rows of documents give equal rows of results; repeated item_ids are told apart
    by their text and reported under their id; a null id is reported as null. Other columns aren't read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text")
        index = docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in block.collect()]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            found, totals = index.value, {}
            for item in found.items:
                totals[item] = totals.get(item, 0) + 1
            for batch in (x for b in batches for x in common.slices(b, most=GROUP)):
                ids, rows = batch.column(0).to_pylist(), {}
                for text, s, first, last, edits, _ in found.scan(batch.column(1).to_pylist()):
                    old = rows.get((text, found.items[s]), (0, 0, first, last))
                    rows[text, found.items[s]] = (old[0] + 1, old[1] + edits, min(old[2], first), max(old[3], last))
                if rows:
                    columns = list(zip(*((ids[t], item, n, totals[item], e, a, b) for (t, item), (n, e, a, b) in rows.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], _LEAK)

        leaks = common.id_and_text(docs).mapInArrow(common.lean(run), ", ".join(f"{c} long" for c in _LEAK))
        out = leaks if out is None else out.unionByName(leaks)
    return out


_LEAK = ["doc_id", "item_id", "n_segments", "of_segments", "edits", "first_char", "last_char"]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no leak, all columns, whatever their names.

    Rows without doc_id can't be named and stay; of repeated rows all go or all stay; null and empty texts stay; an empty
    table gives an empty one.
    """
    leaked = find_leaks(docs, benchmark).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return common.without_ids(docs, common.written(leaked, "leaked"))
