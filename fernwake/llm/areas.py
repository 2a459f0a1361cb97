"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernwake.functions.text import sentences
from fernwake.session import Scratch

BUCKETS, DIM = 1 << 15, 16
MOST_LABELLED = 20_000  # documents that the classifier is fitted on
SHARDS = 12  # parts of the training sample; fixed, so that the fit doesn't depend on the cluster
ROUNDS, RATE = 40, 0.1
WARM = 0.4  # of the rounds, before sentences are told apart in a document
CLEAR, SURE, LEAST_SENTENCES = 0.5, 0.3, 3  # probabilities in training and scoring; sentences a document
MOST_KNOWN = 200_000  # words that a worker keeps
MOST_AREAS = 4096
SCORED = 8_000_000  # words x areas that are scored at a time


def pieces(word: str) -> np.ndarray:
    """Buckets of a word and of its runs of three to five characters; a stated hash, alike everywhere."""
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return np.array(sorted({zlib.crc32(g.encode()) % BUCKETS for g in [f"={word}", *grams]}), np.int64)


@dataclass
class Model:
    """Embeddings of buckets, and a weight vector and bias for each area."""

    emb: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, areas: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, areas)).astype(np.float32), np.full(areas, -2.0, np.float32))

    def words(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A word is the mean of its buckets."""
        n = np.diff(np.r_[starts, len(flat)])
        return np.add.reduceat(self.emb[flat], starts, axis=0) / n[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Corpus:
    """Sentences of some documents as one array of word numbers."""

    def __init__(self, docs: list[list[list[str]]]) -> None:
        number: dict[str, int] = {}
        self.doc, flat, lengths = [], [], []
        for d, doc in enumerate(docs):
            for s in doc:
                self.doc.append(d)
                lengths.append(len(s))
                flat += [number.setdefault(w, len(number)) for w in s]
        self.doc = np.array(self.doc, np.int64)
        self.flat, self.lengths = np.array(flat, np.int64), np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        parts = [pieces(w) for w in number]
        self.pieces = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.piece_starts, self.piece_n = np.cumsum(sizes) - sizes, sizes
        # what every round needs: buckets met, and the sorted order of words and of buckets
        self.met, at = np.unique(self.pieces, return_inverse=True)
        self.by_word, self.by_bucket = _Sums(self.flat, len(sizes)), _Sums(at, len(self.met))
        self.sentence_of = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.word_of = np.repeat(np.arange(len(sizes)), sizes)

    def scores(self, m: Model) -> np.ndarray:
        """Probability of each area for each sentence."""
        if not len(self.doc):
            return np.zeros((0, m.out.shape[1]), np.float32)
        logits = m.words(self.pieces, self.piece_starts) @ m.out
        return _sigmoid(np.add.reduceat(logits[self.flat], self.starts, axis=0) / self.lengths[:, None] + m.bias)


def _targets(c: Corpus, y: np.ndarray, p: np.ndarray, warm: bool) -> np.ndarray:
    """What each sentence should be. First, its document's areas; later, those of them that the
    sentence itself is likely to deal with, and at least the document's three likeliest."""
    t = y[c.doc].astype(np.float32)
    if warm:
        return t
    keep = p > CLEAR
    for a in range(y.shape[1]):
        by = np.lexsort((-p[:, a], c.doc))
        first = np.r_[0, np.flatnonzero(np.diff(c.doc[by])) + 1] if len(by) else np.zeros(0, int)
        nth = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
        keep[by[nth < LEAST_SENTENCES], a] = True
    return t * keep


def gradient(c: Corpus, y: np.ndarray, m: Model, warm: bool) -> tuple[np.ndarray, Model, int]:
    """The summed gradient of a shard's cross-entropy: for the buckets it met, and the number of sentences."""
    if not len(c.doc):
        return c.met, Model(np.zeros((0, DIM), np.float32), np.zeros_like(m.out), np.zeros_like(m.bias)), 0
    w = m.words(c.pieces, c.piece_starts)
    x = np.add.reduceat(w[c.flat], c.starts, axis=0) / c.lengths[:, None]
    p = _sigmoid(x @ m.out + m.bias)
    g = (p - _targets(c, y, p, warm)).astype(np.float32)
    gx = (g @ m.out.T / c.lengths[:, None]).astype(np.float32)
    # words of sentences, then buckets of words
    gw = (c.by_word(gx, c.sentence_of) / c.piece_n[:, None]).astype(np.float32)
    emb = c.by_bucket(gw, c.word_of)
    return c.met, Model(emb.astype(np.float32), (x.T @ g).astype(np.float32), g.sum(0).astype(np.float32)), len(c.doc)


class _Sums:
    """Sums of rows by a key that stays the same from round to round, over sorted runs instead of scattered adds."""

    def __init__(self, key: np.ndarray, n: int) -> None:
        self.n, self.order = n, np.argsort(key, kind="stable")
        by = key[self.order]
        self.first = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.zeros(0, np.int64)
        self.at = by[self.first]

    def __call__(self, rows: np.ndarray, row_of: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, rows.shape[1]), rows.dtype)
        if len(self.at):
            out[self.at] = np.add.reduceat(rows[row_of[self.order]], self.first, axis=0)
        return out


class Adam:
    """Adaptive steps on the summed gradients; a bucket that no shard met keeps its place."""

    def __init__(self, m: Model, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.state = [(np.zeros_like(x), np.zeros_like(x)) for x in (m.emb, m.out, m.bias)]

    def step(self, m: Model, grads: tuple[np.ndarray, ...]) -> None:
        self.t += 1
        for x, g, (first, second) in zip((m.emb, m.out, m.bias), grads, self.state):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            x -= self.rate * (first / (1 - 0.9**self.t)) / (np.sqrt(second / (1 - 0.99**self.t)) + 1e-8) * (second > 0)


def labelled(docs: DataFrame, labels: DataFrame, areas: list[str], doc_id: str, text: str, most: int = MOST_LABELLED) -> DataFrame:
    """doc, text, shard and the numbers of its areas, of at most ``most`` labelled documents by a hash of the id.

    Labels are read without case and outer blanks; null ones and unknown areas say nothing, and
    repeated ones count once. Documents without a known label or text are no sample.
    """
    known = {a.strip().lower(): i for i, a in enumerate(areas)}
    pairs = labels.sparkSession.createDataFrame(list(known.items()), "name string, area int")
    y = labels.select(F.col(doc_id).cast("long").alias("doc"), F.lower(F.trim("area")).alias("name")).dropna().join(F.broadcast(pairs), "name")
    y = y.groupBy("doc").agg(F.sort_array(F.collect_set("area")).alias("areas")).orderBy(F.xxhash64("doc"), "doc").limit(most)
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).dropna()
    d = d.join(y, "doc").groupBy("doc").agg(F.max("text").alias("text"), F.max("areas").alias("areas"))
    return d.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(SHARDS)).cast("int"))


def fit(sample: DataFrame, areas: int, rounds: int = ROUNDS, rate: float = RATE, seed: int = 5) -> Model:
    """A model fitted on ``labelled`` documents by full gradients, synchronised in every round.

    Each shard is taken apart once and written. It sends the gradient of its sentences for the buckets it met (at most 2.2 MB); the
    driver adds the shards' gradients up, takes one step and sends the new model with the next round.
    """
    scratch = Scratch(sample.sparkSession, "areas")
    # a stated number of ranges, so that each shard is a file and, in every round, a task of its own
    kept = scratch.keep(sample.repartitionByRange(SHARDS, "shard").groupBy("shard").applyInArrow(_parser(areas), "shard int, corpus binary"), "sample")
    model = Model.new(areas, seed)
    adam = Adam(model, rate)
    for r in range(rounds):
        got = kept.mapInArrow(_trainer(model, r < rounds * WARM), "met binary, emb binary, out binary, bias binary, n long").toArrow().to_pylist()
        n = sum(row["n"] for row in got)
        if not n:
            break
        emb, out, bias = np.zeros_like(model.emb), np.zeros_like(model.out), np.zeros_like(model.bias)
        for row in sorted(got, key=lambda x: x["met"]):
            emb[np.frombuffer(row["met"], np.int64)] += np.frombuffer(row["emb"], np.float32).reshape(-1, DIM)
            out += np.frombuffer(row["out"], np.float32).reshape(DIM, areas)
            bias += np.frombuffer(row["bias"], np.float32)
        adam.step(model, (emb / n, out / n, bias / n))
    return model


def _parser(areas: int):
    """A shard's documents as a ``Corpus`` with targets, taken apart once for all rounds."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc")
        y = np.zeros((t.num_rows, areas), np.float32)
        for i, a in enumerate(t["areas"].to_pylist()):
            y[i, a] = 1
        packed = pickle.dumps((Corpus([sentences(x) for x in t["text"].to_pylist()]), y), 5)
        return pa.table({"shard": t["shard"].slice(0, 1), "corpus": pa.array([packed], pa.binary())})

    return run


def _trainer(model: Model, warm: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("corpus"):
                met, g, n = gradient(*pickle.loads(packed.as_buffer()), model, warm)
                parts = [met.tobytes(), *(v.astype(np.float32).tobytes() for v in (g.emb, g.out, g.bias))]
                yield pa.RecordBatch.from_arrays([*[pa.array([p], pa.binary()) for p in parts], pa.array([n], pa.int64())], ["met", "emb", "out", "bias", "n"])

    return run


class _Lookup:
    """Each word's logits; words are numbered as they come, and new ones are looked up together."""

    def __init__(self, m: Model) -> None:
        self.m, self.number, self.table = m, {}, np.zeros((1024, m.out.shape[1]), np.float32)

    def __call__(self, flat: list[str]) -> np.ndarray:
        if len(self.number) > MOST_KNOWN:
            self.number = {}
        had = len(self.number)
        at = [self.number.setdefault(w, len(self.number)) for w in flat]
        n = len(self.number)
        if n > had:
            if n > len(self.table):
                self.table = np.concatenate([self.table[:had], np.zeros((2 * n - had, self.table.shape[1]), np.float32)])
            parts = [pieces(w) for w in list(self.number)[had:]]
            sizes = np.array([len(p) for p in parts])
            self.table[had:n] = self.m.words(np.concatenate(parts), np.cumsum(sizes) - sizes) @ self.m.out
        return self.table[at]


def score(docs: DataFrame, model: Model, areas: list[str], doc_id: str, text: str, least: int = LEAST_SENTENCES, sure: float = SURE) -> DataFrame:
    """doc, area, ``n_sentences`` that deal with the area and ``n_all``, where there are ``least`` or more.

    Every document and its whole text is scored. A document without id or text deals with nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(shared.value)
        bar = np.log(sure / (1 - sure))
        most = max(1, SCORED // len(areas)) if areas else 1
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hits, n_all = np.zeros((len(ids), len(areas)), np.int64), np.zeros(len(ids), np.int64)
            flat: list[str] = []
            lengths: list[int] = []
            of: list[int] = []

            def flush() -> None:
                if of:
                    logits = np.add.reduceat(lookup(flat), np.cumsum(lengths) - lengths, axis=0) / np.array(lengths)[:, None] + shared.value.bias
                    np.add.at(hits, of, logits > bar)
                    flat.clear(), lengths.clear(), of.clear()

            for d, t in enumerate(texts):
                for s in sentences(t):
                    flat += s
                    lengths.append(len(s))
                    of.append(d)
                    n_all[d] += 1
                    if len(flat) > most:
                        flush()
            flush()
            d, a = np.nonzero(hits >= least)
            names = pa.DictionaryArray.from_arrays(pa.array(a.astype(np.int32)), pa.array(areas, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), names, pa.array(hits[d, a].astype(np.int32)), pa.array(n_all[d].astype(np.int32))], ["doc", "area", "n_sentences", "n_all"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).dropna()
    return d.mapInArrow(run, "doc long, area string, n_sentences int, n_all int")


def document_areas(docs: DataFrame, labels: DataFrame, areas: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The areas of every document (see ``score``), by a model fitted on the labelled ones."""
    names = [r[0] for r in areas.select("area").dropna().distinct().orderBy("area").limit(MOST_AREAS + 1).collect()]
    if len(names) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} areas")
    model = fit(labelled(docs, labels, names, doc_id, text), len(names))
    return score(docs, model, names, doc_id, text).groupBy("doc", "area").agg(F.max("n_sentences").alias("n_sentences"), F.max("n_all").alias("n_all"))


def composition(found: DataFrame, docs: DataFrame, doc_id: str) -> DataFrame:
    """Documents and sentences of each area, and the share of all documents that deal with it."""
    all_docs = docs.select(F.countDistinct(doc_id).alias("_all"))
    by = found.groupBy("area").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))
    return by.crossJoin(F.broadcast(all_docs)).withColumn("share", F.try_divide("n_docs", "_all")).drop("_all")
