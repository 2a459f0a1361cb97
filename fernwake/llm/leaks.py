"""Test passages inside a corpus, by a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.text import words
from fernwake.session import Scratch

RAREST = 3  # words of each half that an alignment is first held against
ITEM_WORDS = 400_000  # words of test items that stand on every worker at a time; more are searched block by block
SEGMENT_WORDS = 100_000  # words after which an index segment is closed
AT_ONCE = 1 << 20  # alignments held at a time
OFFSET = 1 << 24  # more than any item's words
GAP = 64  # free places between two documents of a segment, at least

SEGMENT = "docs array<long>, bases array<long>, terms array<int>, places array<long>"
FOUND = "doc long, item long, phrase int, near int"


class Items:
    """Words of the test items as term numbers, and the places where alignments begin.

    Every window of ``least`` words has an anchor, its rarest term by the number of postings in the
    corpus; windows with a term that no document holds can still match in part only, so they have
    none. ``beside`` names for each anchor the rarest words of the half window before and after it,
    one half of which lies in any match around the anchor.
    """

    def __init__(self, items: list[tuple[int, list[str]]], least: int) -> None:
        self.ids, self.least = np.array([i for i, _ in items], np.int64), least
        self.number: dict[str, int] = {}
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in ws], np.int64) for _, ws in items]
        self.starts = np.cumsum([0, *map(len, self.words)])
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        self.lengths = np.diff(self.starts)
        self.starts = self.starts[:-1]
        self.longest = max(map(len, self.words), default=0)

    def anchor(self, postings: np.ndarray) -> None:
        item, at, beside, wanted = [], [], [], []
        half = self.least // 2
        for n, w in enumerate(self.words):
            if len(w) < self.least:
                continue
            counts = postings[w]
            windows = np.lib.stride_tricks.sliding_window_view(counts, self.least)
            best = np.unique(np.arange(len(windows))[windows.min(1) > 0] + windows.argmin(1)[windows.min(1) > 0])
            for i in best:
                sides = []
                for lo, hi in ((i - half, i), (i + 1, i + 1 + half)):
                    if lo >= 0 and hi <= len(w):
                        sides.append(lo + np.argsort(counts[lo:hi], kind="stable")[:RAREST])
                item.append(n)
                at.append(i)
                row = np.full((2, RAREST), -1)
                for k, s in enumerate(sides):
                    row[k, : len(s)] = s
                beside.append(row)
                wanted.append(len(sides))
        self.item, self.at = np.array(item, np.int64), np.array(at, np.int64)
        self.beside = np.array(beside, np.int64).reshape(-1, 2, RAREST)
        self.sides = np.array(wanted, np.int64)
        self.term = self.flat[self.starts[self.item] + self.at] if len(self.item) else np.zeros(0, np.int64)


class Segment:
    """Postings of some whole documents: their places on one line, sorted by (term, place)."""

    def __init__(self, docs: np.ndarray, bases: np.ndarray, terms: np.ndarray, places: np.ndarray) -> None:
        self.docs, self.bases = docs, bases
        self.width = int(places.max()) + 1 if len(places) else 0
        self.span = self.width + 2 * OFFSET  # so that no offset runs from one term into another
        self.keys = terms.astype(np.int64) * self.span + places
        self.places = places

    def list_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginning and end of each term's postings."""
        return np.searchsorted(self.keys, terms * self.span), np.searchsorted(self.keys, terms * self.span + self.width)

    def meets(self, terms: np.ndarray, places: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term has a posting within ``slop`` of the place."""
        want = terms * self.span + places
        at = np.searchsorted(self.keys, want - slop)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= want + slop)


def _longest_runs(hit: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Longest run of true values in each of the stretches that begin at ``starts``."""
    at = np.arange(len(hit))
    stop = np.where(hit, -1, at)  # the last place before a run: a miss, or the place before the stretch
    stop[starts] = np.where(hit[starts], starts - 1, starts)
    return np.maximum.reduceat(np.where(hit, at - np.maximum.accumulate(stop), 0), starts)


def search(seg: Segment, items: Items, least: int, slop: int) -> list[np.ndarray]:
    """doc, item, phrase and near of the segment's matches (see ``leaked``)."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
    if not len(items.item) or not len(seg.keys):
        return [x[0] for x in out]
    lo, hi = seg.list_of(items.term)
    size = hi - lo
    order = np.argsort(items.item, kind="stable")
    ahead = np.cumsum(size[order])
    cuts = [0, *(np.flatnonzero(np.diff(ahead // AT_ONCE)) + 1).tolist(), len(order)]
    for a, b in zip(cuts, cuts[1:]):
        anchors = order[a:b]
        n = size[anchors]
        anchor = np.repeat(anchors, n)
        nth = np.arange(len(anchor)) - np.repeat(np.cumsum(n) - n, n)
        shift = seg.places[lo[anchor] + nth] - items.at[anchor]
        keep = np.zeros(len(anchor), bool)
        for side in range(2):  # a match holds the half window before the anchor or the one after it
            left = np.flatnonzero(~keep & (items.sides[anchor] > side))
            for k in range(RAREST):
                at = items.beside[anchor[left], side, k]
                term = items.flat[items.starts[items.item[anchor[left]]] + np.maximum(at, 0)]
                left = left[(at < 0) | seg.meets(term, shift[left] + at, 2 * slop)]
            keep[left] = True
        item, shift = items.item[anchor[keep]], shift[keep]
        # the anchor stands exactly here; in a proximity match it may itself be up to ``slop`` off
        every = np.arange(-slop, slop + 1)
        pairs = np.unique(np.repeat(item, len(every)) * seg.span + (shift[:, None] + every + OFFSET).ravel())
        n, s = pairs // seg.span, pairs % seg.span - OFFSET
        words = np.cumsum(items.lengths[n])
        chunks = [0, *(np.flatnonzero(np.diff(words // AT_ONCE)) + 1).tolist(), len(n)]
        for c, d in zip(chunks, chunks[1:]):
            if c < d:
                for x, v in zip(out, _compare(seg, items, n[c:d], s[c:d], least, slop)):
                    x.append(v)
    return [np.concatenate(x) for x in out]


def _compare(seg: Segment, items: Items, n: np.ndarray, shift: np.ndarray, least: int, slop: int) -> tuple[np.ndarray, ...]:
    """doc, item, phrase and near of the alignments (item, shift) that hold ``least`` words in a row."""

    def hits(n: np.ndarray, shift: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
        size = items.lengths[n]
        starts = np.cumsum(size) - size
        word = np.arange(size.sum()) - np.repeat(starts, size)
        return seg.meets(items.flat[np.repeat(items.starts[n], size) + word], np.repeat(shift, size) + word, tolerance), starts

    near, starts = hits(n, shift, slop)
    run = _longest_runs(near, starts)
    good = run >= least
    if not good.any():
        return (np.zeros(0, np.int64),) * 4
    # an item is shorter than the gap between documents, so any word that is met tells the document
    at = np.minimum.reduceat(np.where(near, np.arange(len(near)), len(near)), starts)[good] - starts[good]
    doc = np.searchsorted(seg.bases, shift[good] + at + slop, "right") - 1
    phrase = _longest_runs(*hits(n[good], shift[good], 0))
    return seg.docs[doc], items.ids[n[good]], phrase, run[good]


def _segment(docs: list[int], bases: list[int], terms: list[int], places: list[int]) -> pa.RecordBatch:
    t, p = np.array(terms, np.int32), np.array(places, np.int64)
    by = np.lexsort((p, t))
    cols = [pa.array([x], pa.list_(k)) for x, k in ((np.array(docs, np.int64), pa.int64()), (np.array(bases, np.int64), pa.int64()), (t[by], pa.int32()), (p[by], pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, ["docs", "bases", "terms", "places"])


def index(docs: DataFrame, number, gap: int) -> DataFrame:
    """The positional inverted index of ``docs`` (doc, text), one row a segment of whole documents.

    A segment has the postings (term, place) of some documents sorted by term, their places counted
    on over the documents with ``gap`` free ones between them. ``number`` is a broadcast of the
    terms that are kept; every word of the whole text takes a place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        held: tuple[list, list, list, list] = ([], [], [], [])
        at = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(t)
                kept = [(known[w], at + j) for j, w in enumerate(ws) if w in known]
                if kept:
                    held[0].append(i)
                    held[1].append(at)
                    term, place = zip(*kept)
                    held[2].extend(term)
                    held[3].extend(place)
                    at += len(ws) + gap
                if len(held[2]) >= SEGMENT_WORDS:
                    yield _segment(*held)
                    held, at = ([], [], [], []), 0
        if held[0]:
            yield _segment(*held)

    return docs.mapInArrow(run, SEGMENT)


def leaked(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, least: int = 12, slop: int = 2, item_words: int = ITEM_WORDS) -> DataFrame:
    """Documents that hold ``least`` or more consecutive words of an item: doc, item, phrase, near.

    ``phrase`` is the longest run of the item's words that stands in the document word for word, of
    those alignments in which ``near`` reaches ``least``; ``near`` is the longest run in which each
    word is within ``slop`` places of where one alignment of the item puts it, if ``least`` words of
    it in a row are. Rows have near >= least; those with phrase >= least are exact leaks, the others
    proximity matches.

    The corpus is read once: each task writes an inverted index of the items' terms over its
    documents, so no posting is shuffled. A second pass over the index intersects offset-adjusted
    lists inside each segment: from every window's rarest term, first with the rarest words of the
    half windows beside it, and, where these meet, with all the item's words.

    Texts are taken whole. Null texts, and items or documents without id, have no words. Items
    shorter than ``least`` words are matched by nothing. Equal documents each come out under their
    id; of a document id with several texts, what any of them holds counts; an item id with several
    texts has the largest. Items of more than ``item_words`` words in all are searched in blocks of
    that size, with one pass over the corpus a block.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    known = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).dropna()
    test = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).dropna().groupBy("item").agg(F.max("text").alias("text"))
    out = None
    for block in _blocks(test, item_words):
        part = Items(block, least)
        segments = scratch.keep(index(known, spark.sparkContext.broadcast(part.number), max(GAP, part.longest + 2 * slop + 2)), "index")
        part.anchor(_postings(segments, len(part.number)))
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    seg = Segment(*(batch.column(c)[i].values.to_numpy() for c in range(4)))
                    d, n, phrase, near = search(seg, shared.value, least, slop)
                    yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(n), pa.array(phrase.astype(np.int32)), pa.array(near.astype(np.int32))], ["doc", "item", "phrase", "near"])

        found = segments.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], FOUND)
    return out.groupBy("doc", "item").agg(F.max("phrase").alias("phrase"), F.max("near").alias("near"))


def _blocks(test: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in blocks of about ``most`` words (one item at least), read one partition at a time."""
    block, held = [], 0
    for r in test.toLocalIterator():
        ws = words(r["text"])
        if block and held + len(ws) > most:
            yield block
            block, held = [], 0
        block.append((r["item"], ws))
        held += len(ws)
    if block:
        yield block


def _postings(segments: DataFrame, terms: int) -> np.ndarray:
    """Number of postings of each term of a block of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(n, pa.int64())], ["term", "n"])

    got = segments.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, np.int64)
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


def brute_force(doc: str, item: str, least: int, slop: int = 0) -> tuple[int, int]:
    """phrase and near of a document and an item by trying every alignment; 0 where near stays below ``least``."""
    d, i = words(doc), words(item)
    best = (0, 0)
    for s in range(-len(i) - slop, len(d) + slop + 1):
        runs = []
        for tolerance in (0, slop):
            run = longest = 0
            for j, w in enumerate(i):
                run = run + 1 if any(0 <= p < len(d) and d[p] == w for p in range(s + j - tolerance, s + j + tolerance + 1)) else 0
                longest = max(longest, run)
            runs.append(longest)
        if runs[1] >= least:
            best = (max(best[0], runs[0]), max(best[1], runs[1]))
    return best
