"""Problem 7: evaluation passages that stand in training texts.

Winnowing: both sides are turned into words, every window of WINDOW k-grams of
K words keeps its smallest hash (the rightmost of equals), the fingerprints are
joined and every hit is extended along its diagonal. Two texts that share
K + WINDOW - 1 = 8 words in a row share a fingerprint inside them, so no run of
eight words or more is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, cut_counting
from ..plans.skew import lookup
from .textbytes import pieces, readable

K, WINDOW = 5, 4
RUN = K + WINDOW - 1
#: Share of the words of a passage that must stand in such runs.
SHARE = (2, 5)
#: Passages of at most so many characters are broadcast (about ten bytes for a
#: character) and matched where a text is read; more are joined by fingerprint.
BLOCK_CHARS = 16_000_000
#: Bits for each fingerprint of the passages in the filter that is broadcast for
#: the join, their number by probes, and the bound of its size.
FILTER_BITS, FILTER_PROBES, FILTER_LIMIT = 24, 6, 1 << 31
#: The filter is put together in parts of so many bytes.
FILTER_PART = 1 << 13
SCHEMA = "doc_id long, item_id long, covered_words int, passage_words int"

_NO_WORD = re.compile(r"[\W_]+")
_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _LOWER[_c] = ord(chr(_c).lower()) if _c < 128 else _c
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(2**64 - 1)


def _slow(raw: bytes) -> bytes:
    text = re.sub(r"\\+[nrt]", " ", readable(raw))
    return _NO_WORD.sub(" ", text.lower()).encode()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and the number of words of each text."""
    low = _LOWER[data]
    is_word = low != 0
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    inside = starts[starts < len(data)]
    first[inside] = is_word[inside]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    at = np.flatnonzero(is_word)
    w = np.cumsum(first[at]) - 1
    place = at - begin[w]
    power = np.full(int(place.max()) + 1, _BASE)
    power[0] = 1
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(power)
        value = (low[at].astype(np.uint64) + np.uint64(1)) * power[place]
        hashes = _mixed(np.add.reduceat(value, np.searchsorted(at, begin)))
    counts = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    return hashes, counts


def winnow(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (among all words) and hashes of the kept k-grams.

    Texts of fewer than RUN words have no window and keep nothing.
    """
    n = len(words)
    if n < RUN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = n - K + 1
    with np.errstate(over="ignore"):
        gram = words[:m].copy()
        for j in range(1, K):
            gram = gram * _GRAM + words[j : m + j]
        gram = _mixed(gram)
    windows = n - RUN + 1
    least, pick = gram[:windows].copy(), np.zeros(windows, np.int8)
    for j in range(1, WINDOW):
        lower = gram[j : windows + j] <= least
        least[lower] = gram[j : windows + j][lower]
        pick[lower] = j
    ends = np.cumsum(counts)
    inside = np.ones(n + 1, bool)
    for back in range(1, RUN):  # windows that cross the end of a text
        inside[np.maximum(ends - back, 0)] = False
    # An end less RUN - 1 words may lie in an earlier, shorter text; those
    # windows cross that text's end as well, so nothing is lost.
    at = np.flatnonzero(inside[:windows])
    kept = np.unique(at + pick[at])
    return kept, gram[kept]


@dataclass
class Passages:
    """Winnowed passages: sorted fingerprints and where they stand."""

    item_id: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    prints: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray


class _Texts(NamedTuple):
    words: np.ndarray
    counts: np.ndarray
    rows: np.ndarray


def texts_as_words(batch: pa.RecordBatch, text: str) -> Iterator[_Texts]:
    """Word hashes of whole rows; the pieces of a long text are put together."""
    held: list[tuple[np.ndarray, int]] = []

    def joined() -> _Texts:
        words = np.concatenate([w for w, _ in held])
        return _Texts(words, np.array([len(words)]), np.array([held[0][1]]))

    for data, starts, ends, rows in pieces(batch, text, _slow):
        words, counts = word_hashes(data, starts, ends)
        if len(rows) == 1:
            if held and held[0][1] != rows[0]:
                yield joined()
                held.clear()
            held.append((words, int(rows[0])))
            continue
        if held:
            yield joined()
            held.clear()
        yield _Texts(words, counts, rows)
    if held:
        yield joined()


def prepare(item_ids: list[int], passages: list[str | None]) -> Passages:
    batch = pa.RecordBatch.from_arrays([pa.array([p or "" for p in passages], pa.string())], ["p"])
    by_row: dict[int, np.ndarray] = {}
    for words, counts, rows in texts_as_words(batch, "p"):
        for r, w in zip(rows, np.split(words, np.cumsum(counts)[:-1]), strict=True):
            by_row[int(r)] = w
    each = [by_row.get(i, np.zeros(0, np.uint64)) for i in range(len(item_ids))]
    counts = np.array([len(w) for w in each], np.int64)
    words = np.concatenate(each) if each else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    kept, prints = winnow(words, counts)
    order = np.argsort(prints, kind="stable")
    unique, first = np.unique(prints[order], return_index=True)
    item = np.searchsorted(offsets, kept[order], "right") - 1
    return Passages(np.array(item_ids, np.int64), words, offsets, unique, np.append(first, len(order)), item, kept[order] - offsets[item])


def _runs(same: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return [(a, b) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= RUN]


def covered(doc: np.ndarray, passage: np.ndarray, diagonals: np.ndarray) -> int:
    """Words of the passage in runs of RUN or more along the given diagonals
    (position in the text less position in the passage)."""
    mark = np.zeros(len(passage), bool)
    for d in diagonals:
        a, b = max(0, -int(d)), min(len(passage), len(doc) - int(d))
        for x, y in _runs(doc[a + d : b + d] == passage[a:b]):
            mark[a + x : a + y] = True
    return int(mark.sum())


def enough(hits, size):
    """Whether so many hits can make a leak of a passage of so many words. A run
    of r words holds at least (r - RUN + 1) / WINDOW fingerprints, so h hits
    cover at most (WINDOW + RUN - 1) * h words: most pairs end here."""
    return hits * ((WINDOW + RUN - 1) * SHARE[1]) >= size * SHARE[0]


def matches(words: np.ndarray, counts: np.ndarray, known: Passages) -> Iterator[tuple[int, int, int, int]]:
    """``(text, item, covered words, words of the passage)`` of leaked items."""
    kept, prints = winnow(words, counts)
    if not len(kept) or not len(known.prints):
        return
    at = np.minimum(np.searchsorted(known.prints, prints), len(known.prints) - 1)
    hit = known.prints[at] == prints
    kept, at = kept[hit], at[hit]
    if not len(kept):
        return
    ends = np.cumsum(counts)
    text = np.searchsorted(ends, kept, "right")
    lengths = known.first[at + 1] - known.first[at]
    # Hits are expanded text by text, so that memory stays bounded.
    per_text = np.flatnonzero(np.diff(text, prepend=-1))
    for a, b in zip(per_text, np.append(per_text[1:], len(text)), strict=True):
        where = np.concatenate([np.arange(known.first[x], known.first[x + 1]) for x in at[a:b]])
        item, place = known.item[where], known.place[where]
        pos = np.repeat(kept[a:b], lengths[a:b])
        t = int(text[a])
        begin = int(ends[t] - counts[t])
        order = np.argsort(item, kind="stable")
        which, first, n_hits = np.unique(item[order], return_index=True, return_counts=True)
        size = known.offsets[which + 1] - known.offsets[which]
        for k in np.flatnonzero(enough(n_hits, size)):
            mine, i = order[first[k] : first[k] + n_hits[k]], int(which[k])
            diagonals = np.unique(pos[mine] - begin - place[mine])
            n = covered(words[begin : int(ends[t])], known.words[known.offsets[i] : known.offsets[i + 1]], diagonals)
            if n * SHARE[1] >= size[k] * SHARE[0]:
                yield t, i, n, int(size[k])


def find_leaks(documents: DataFrame, items: DataFrame, block_chars: int | None = None) -> DataFrame:
    """``doc_id, item_id, covered_words, passage_words`` of every leaked item.

    A document leaks an item when at least two fifths of the words of the
    passage stand in the text in unbroken runs of eight words or more. Items
    with the same passage are all leaked. Null or empty texts and passages, and
    passages of fewer than eight words, leak nothing; repeated ids give one row
    with the larger cover. Texts are read whole, whatever their length; extra
    columns are ignored. The documents are read once. Passages of at most
    ``block_chars`` (BLOCK_CHARS) characters in all are broadcast, and only leaks leave the
    scan; more are joined with the documents by fingerprint, with the same
    result (:func:`_joined`).
    """
    spark = documents.sparkSession
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("passage").cast("string").alias("passage")).where("item_id IS NOT NULL AND passage IS NOT NULL")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.length("passage").cast("long"))).first()[0]
    if not size:
        return spark.createDataFrame([], SCHEMA)
    out = _scanned(docs, rows) if size <= (BLOCK_CHARS if block_chars is None else block_chars) else _joined(docs, rows)
    return out.groupBy("doc_id", "item_id").agg(F.max("covered_words").alias("covered_words"), F.max("passage_words").alias("passage_words"))


def _scanned(docs: DataFrame, rows: DataFrame) -> DataFrame:
    few = rows.collect()
    shared = docs.sparkSession.sparkContext.broadcast(prepare([r[0] for r in few], [r[1] for r in few]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids, found = batch.column(0), []
            for words, counts, rows in texts_as_words(batch, "text"):
                found += [(ids[int(rows[t])].as_py(), int(known.item_id[i]), n, of) for t, i, n, of in matches(words, counts, known)]
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["doc_id", "item_id", "covered_words", "passage_words"])

    return docs.mapInArrow(scan, SCHEMA)


def _probes(prints: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a filter (a power of two of them) that each fingerprint sets."""
    step = _mixed(prints) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(prints + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(FILTER_PROBES)])


def _filter(prints: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the column ``print``, as bytes: its parts are put
    together by tasks, and their number is bounded by FILTER_LIMIT bits."""
    bits = FILTER_PART * 8
    while bits < min(n * FILTER_BITS, FILTER_LIMIT):
        bits *= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_probes(batch.column(0).to_numpy().view(np.uint64), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // (FILTER_PART * 8)), pa.array((at % (FILTER_PART * 8)).astype(np.int32))], ["part", "bit"])

    def part(key, table):
        own = np.zeros(FILTER_PART * 8, np.uint8)
        own[table.column("bit").to_numpy()] = 1
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    made = prints.select("print").mapInArrow(spread, "part long, bit int").groupBy("part").applyInArrow(part, "part long, data binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in made.toLocalIterator():
        out[r["part"] * FILTER_PART : (r["part"] + 1) * FILTER_PART] = np.frombuffer(r["data"], np.uint8)
    return out


def _known(filled: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints may be in the filter."""
    found = np.ones(len(prints), bool)
    for at in _probes(prints, len(filled) * 8):
        found &= (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return found


_PRINTED = "id long, no long, n_words int, words binary, prints array<long>, places array<int>"


def _printed(df: DataFrame, text: str, filled=None) -> DataFrame:
    """``id, no, n_words, words, prints, places``: the words of every text (hashes) with its
    fingerprints; with a filter only the fingerprints that it knows and the
    texts that have any. ``no`` is the text's own number."""
    own = df.select(F.col(df.columns[0]).alias("id"), F.monotonically_increasing_id().alias("no"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nos = batch.column(0), batch.column(1)
            for words, counts, rows in texts_as_words(batch, "text"):
                kept, prints = winnow(words, counts)
                if filled is not None and len(kept):
                    hit = _known(filled.value, prints)
                    kept, prints = kept[hit], prints[hit]
                if not len(kept):
                    continue
                ends = np.cumsum(counts)
                text_of = np.searchsorted(ends, kept, "right")
                which, first = np.unique(text_of, return_index=True)
                begin = (ends - counts)[which]
                at = rows[which]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)), nos.take(pa.array(at)), pa.array(counts[which], pa.int32()), pa.array([words[b:e].tobytes() for b, e in zip(begin, ends[which], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(kept)), pa.int32()), pa.array(prints.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(kept)), pa.int32()), pa.array(kept - np.repeat(begin, np.diff(np.append(first, len(kept)))), pa.int32())),
                ], ["id", "no", "n_words", "words", "prints", "places"])

    return own.mapInArrow(scan, _PRINTED)


def _joined(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The leaks by a join of fingerprints. A filter of the passages'
    fingerprints, of bounded size, is broadcast and stops nearly all texts in
    the one scan; the others give their words and the fingerprints known.
    Frequent fingerprints, passages and texts are looked up by broadcast."""
    passages = cut(_printed(rows, "passage"))
    postings, n = cut_counting(passages.select("no", "n_words", F.inline(F.arrays_zip("prints", "places"))).select(F.col("prints").alias("print"), F.struct("no", "n_words", F.col("places").alias("place")).alias("at")).groupBy("print").agg(F.collect_list("at").alias("at")))
    filled = docs.sparkSession.sparkContext.broadcast(_filter(postings, n))
    texts = cut(_printed(docs, "text", filled))
    hits, n = cut_counting(texts.select(F.col("no").alias("text_no"), F.inline(F.arrays_zip("prints", "places"))).select("text_no", F.col("prints").alias("print"), F.col("places").alias("pos")))
    met = lookup(hits, "print", postings, "inner", n).select("text_no", "pos", F.inline("at"))
    pairs = met.groupBy("text_no", "no", "n_words").agg(F.count(F.lit(1)).alias("h"), F.collect_set(F.col("pos") - F.col("place")).alias("diagonals"))
    likely, n = cut_counting(pairs.where(enough(F.col("h"), F.col("n_words"))).select("text_no", "no", "diagonals"))
    with_passage = lookup(likely, "no", passages.select("no", F.col("id").alias("item_id"), F.col("words").alias("passage")), "inner", n)
    both = lookup(with_passage, "text_no", texts.select(F.col("no").alias("text_no"), F.col("id").alias("doc_id"), "words"), "inner", n)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, item, words, passage, diagonals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(passage, np.uint64)
                k = covered(np.frombuffer(words, np.uint64), own, np.array(diagonals))
                if k * SHARE[1] >= len(own) * SHARE[0]:
                    found.append((doc, item, k, len(own)))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "item_id", "covered_words", "passage_words"])

    return both.select("doc_id", "item_id", "words", "passage", "diagonals").mapInArrow(extend, SCHEMA)


def leaks_by_item(leaks: DataFrame) -> DataFrame:
    """``item_id, n_documents, most_covered``: what leaked, and how often."""
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.max(F.col("covered_words") / F.col("passage_words")), 6).alias("most_covered"))
