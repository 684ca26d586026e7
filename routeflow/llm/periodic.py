"""Periodic run detection: every maximal repetition of words in each text, and texts without the repeats.

A *run* is a stretch of words with smallest period p that no neighbouring word extends. By the runs theorem the Lyndon root
of a run, under one of the two orders of words, is the longest Lyndon word that starts there. So each position gives two
candidates, whose ends are the next smaller and the next greater value of the inverse suffix array. A candidate is
extended to the right by the longest common prefix of two suffixes, which is a minimum over the LCP array (sparse table), and
to the left by the same on reversed texts. That finds all runs in O(n log n), whatever their periods.

Many texts are handled at once as numpy arrays of word numbers: ranks are refined by prefix doubling, only where they still
tie, and only within a text. A text is one row and stays in one task; there is no shuffle.

Defined cases: null and empty texts have no words, no runs, and an empty text back; texts without a run get their words
back, joined by one space; very long texts are handled whole, alone in their batch (some 200 bytes a word); null or repeated
ids mean nothing here, rows are handled apart; an empty table gives an empty result; other columns pass through untouched,
whatever their names, but for ``n_words`` and ``runs``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from routeflow.llm.storage import in_arrow, slices

#: Words of a run at least, and how often its period must fit.
LEAST, TIMES = 6, 4
#: Bytes of text handled at once, besides a text that is longer.
AT_ONCE = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (what stands between ASCII white space), and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    keep = pc.greater(pc.binary_length(lists.values), 0)
    before = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))])
    return lists.values.filter(keep), before[lists.offsets.to_numpy()]


def _ends(cuts: np.ndarray) -> np.ndarray:
    return np.repeat(cuts[1:], np.diff(cuts))


def ranks(words: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: the rank of each position among those of its text by its first 2**k words; equal ones share a rank.
    A text's end comes before all words, texts follow one another. The last entry is the inverse suffix array."""
    n, ends = len(words), _ends(cuts)
    texts = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    key = texts * (int(words.max()) + 1 if n else 1) + words
    order = np.argsort(key, kind="stable")
    rank, tied = _ranked(key[order], None, order, np.zeros(n, np.int32), np.zeros(n, np.int64))
    out, span = [rank], 1
    while len(tied):
        last = out[-1]
        ahead = tied + span
        second = np.where(ahead < ends[tied], last[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, last[tied]))
        rank, tied = _ranked(last[tied[order]], second[order], tied[order], last.copy(), last[tied[order]])
        out.append(rank)
        span *= 2
    return out


def _ranked(first: np.ndarray, second: np.ndarray | None, places: np.ndarray, rank: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of sorted ``places``: what is smaller in its group of equal ``base``, on top of the base. Returns them and the places
    that still share a rank."""
    m = len(places)
    if not m:
        return rank, places
    at = np.arange(m)
    fresh = np.append(True, first[1:] != first[:-1])
    if second is not None:
        fresh[1:] |= second[1:] != second[:-1]
    begin = np.maximum.accumulate(np.where(fresh, at, 0))
    group = np.maximum.accumulate(np.where(np.append(True, base[1:] != base[:-1]), at, 0))
    rank[places] = base + begin - group
    alone = fresh & np.append(fresh[1:], True)
    return rank, places[~alone]


def lcp(levels: list[np.ndarray], cuts: np.ndarray) -> np.ndarray:
    """At each place of the suffix array, how many words its suffix shares with the one before."""
    last, n = levels[-1], len(levels[-1])
    suffixes = np.empty(n, np.int64)
    suffixes[last] = np.arange(n)
    ends, out, equal, pairs = _ends(cuts), np.zeros(n, np.int64), [], np.arange(1, n)
    for rank in levels[:-1]:  # in the last all differ
        pairs = pairs[rank[suffixes[pairs]] == rank[suffixes[pairs - 1]]]
        equal.append(pairs)
    for k in range(len(equal) - 1, -1, -1):
        pairs = equal[k]
        i, j = suffixes[pairs] + out[pairs], suffixes[pairs - 1] + out[pairs]
        inside = (i < ends[suffixes[pairs]]) & (j < ends[suffixes[pairs - 1]])
        same = inside & (levels[k][np.minimum(i, n - 1)] == levels[k][np.minimum(j, n - 1)])
        out[pairs[same]] += 1 << k
    return out


class Extension:
    """How far two suffixes of one text agree, in constant time a pair."""

    def __init__(self, levels: list[np.ndarray], cuts: np.ndarray):
        self.rank = levels[-1]
        self.table = [lcp(levels, cuts).astype(np.int32)]
        longest = int(np.diff(cuts).max(initial=1))
        while 1 << len(self.table) <= longest:  # ranges stay within a text
            row, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(row[:-half], row[half:]) if len(row) > half else row)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For pairs of different positions."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        k = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for level in np.unique(k):
            here, row = k == level, self.table[level]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << int(level)) + 1])
        return out


def next_smaller(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The next position of the same text with a smaller value; the text's end where there is none. All positions jump at
    once: what lies between a position and where it points is greater, so it may follow a greater one's pointer."""
    n, ends = len(values), _ends(cuts)
    out = np.minimum(np.arange(1, n + 1), ends)
    active = np.flatnonzero(out < ends)
    while len(active):
        at = out[active]
        active = active[values[at] > values[active]]
        out[active] = out[out[active]]
        active = active[out[active] < ends[active]]
    return out


def find_runs(words: np.ndarray, cuts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """(start, length, period) of all runs of at least ``least`` words and ``times`` >= 2 periods, in the order of start and
    period; starts are places in ``words``."""
    n, ends = len(words), _ends(cuts)
    none = np.empty((0, 3), np.int64)
    if not n:
        return none
    levels = ranks(words, cuts)
    here, places, right = np.arange(n), [], None
    for values in (levels[-1], -levels[-1]):  # both orders
        after = next_smaller(values, cuts)
        period = after - here
        # the leftmost root of a run lies in its first period, so all but a period and a half of words follow it
        roots = np.flatnonzero((after < ends) & (here + (times - 1) * period + 1 <= ends) & (levels[0] == levels[0][np.minimum(after, n - 1)]))
        if len(roots):
            right = right or Extension(levels, cuts)
            to_right = right.of(roots, after[roots])
            fits = to_right >= (times - 2) * period[roots] + 1
            places.append(np.column_stack([roots, period[roots], to_right])[fits])
    found = np.concatenate(places) if places else none
    if not len(found):
        return none
    i, period, to_right = found.T
    to_left = _to_left(words, cuts, i, i + period)
    out = np.column_stack([i - to_left, to_left + period + to_right, period])
    out = out[out[:, 1] >= np.maximum(least, times * period)]
    return np.unique(out[np.lexsort((out[:, 2], out[:, 0]))], axis=0)


def _to_left(words: np.ndarray, cuts: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j agree, i < j in one text; only texts that hold a pair are reversed."""
    text = np.searchsorted(cuts, i, "right") - 1
    used, own = np.unique(text, return_inverse=True)
    lengths = (cuts[used + 1] - cuts[used]).astype(np.int64)
    turned = np.concatenate([[0], np.cumsum(lengths)])
    places = np.repeat(cuts[used + 1] - 1 + turned[:-1], lengths) - np.arange(turned[-1])
    back = lambda x: turned[own] + cuts[used + 1][own] - x  # noqa: E731  where the word before x stands, reversed
    out, inside = np.zeros(len(i), np.int64), i > cuts[text]
    if inside.any():
        out[inside] = Extension(ranks(words[places], turned), turned).of(back(i)[inside], back(j)[inside])
    return out


def _collapse(text_at: int, least: int, times: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=AT_ONCE):
            words, cuts = words_of(batch.column(text_at))
            found = find_runs(words.dictionary_encode().indices.to_numpy(), cuts, least, times)
            start, length, period = found.T
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            offsets = np.concatenate([[0], np.cumsum(kept)])[cuts].astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(kept))), " ")
            own = np.searchsorted(start, cuts).astype(np.int32)
            local = start - cuts[np.searchsorted(cuts, start, "right") - 1]
            runs = pa.ListArray.from_arrays(pa.array(own), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (local, length, period)], names=["start", "length", "period"]))
            columns = [texts if i == text_at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(cuts), pa.int64()), runs], names=[str(i) for i in range(len(columns) + 2)])

    return run


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` reduced to its words without repeats (of each run the first period stays, as far
    as no other run drops it), plus ``n_words`` before that and ``runs``: (start, length, period), word numbers from 0."""
    if times < 2 or least < 2:
        raise ValueError("a run fits its period twice at least")
    docs = docs.drop("n_words", "runs")
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of our own can't clash
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields] + ["n long", f"found {RUNS}"])
    return rows.transform(in_arrow, _collapse(docs.columns.index(text_col), least, times), schema).toDF(*docs.columns, "n_words", "runs")
