"""Mixing sources to target weights, by cube-method balanced sampling."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernwake.operators.ordering import join_unique
from fernwake.session import Scratch

TOKENIZER = "byte_bpe_50k.tiktoken"
# Fixed value: the pieces that this public vocabulary's pairs are merged in.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GROUP = 20_000  # documents of one flight
MOST_EDITS = 2
MOST_ROUNDS = 20  # of the cube; each leaves two units of 20,000
EPS = 1e-9

UNITS = "source string, doc long, tokens long, p double"


def counter(file: str, content: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of texts, by the content of a tokenizer file: ranks (.tiktoken) or a whole tokenizer (.json).

    Words that stand for special tokens are ordinary text.
    """
    if file.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(content)
        t.encode_special_tokens = True
        encode = getattr(t, "encode_batch_fast", t.encode_batch)  # without offsets, where there is one
        return lambda texts: [len(e.ids) for s in range(0, len(texts), 256) for e in encode(texts[s : s + 256], add_special_tokens=False)]
    import regex
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, content.splitlines())}
    t = tiktoken.Encoding(os.path.basename(file), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    pieces = regex.compile(PIECES)

    def count(text: str) -> int:
        try:
            return len(t.encode_ordinary(text))
        except BaseException as e:  # its matcher gives up on millions of blanks in a row
            if type(e).__name__ != "PanicException":
                raise
            return sum(len(t._encode_single_piece(p.encode())) for p in pieces.findall(text))

    return lambda texts: [count(x) for x in texts]


def with_tokens(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """doc, raw source and number of tokens of the whole text; null texts have none.

    The tokenizer's file is read on the driver and sent to the workers. Equal texts of a batch are
    counted once.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer, shared.value)
        for batch in batches:
            coded = batch.column(2).dictionary_encode()
            sizes = pa.array(tokens(coded.dictionary.to_pylist()), pa.int64()).take(coded.indices).fill_null(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["doc", "filed", "tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(source).alias("filed"), F.col(text).alias("text")).mapInArrow(count, "doc long, filed string, tokens long")


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _shortened(c: Column) -> Column:
    """``c`` and all that is left of it after leaving out one or two characters."""
    less = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    some = lambda x: F.when(F.length(x) > 0, less(x)).otherwise(F.array().cast("array<string>"))
    once = some(c)
    return F.array_distinct(F.concat(F.array(c), once, F.flatten(F.transform(once, some))))


def true_sources(names: DataFrame, targets: DataFrame) -> DataFrame:
    """``source`` of each distinct ``filed`` name that is a target's: the one that it equals once case and all but
    letters and digits are ignored, else the nearest within two edits (ties: the smaller name).

    Two names within two edits have a string in common that is left of both after leaving out at
    most two characters, so they meet in an equi-join of such strings, however many sources there
    are. A filed name longer than any target by more than two characters is none.
    """
    goal = targets.select("source").distinct().withColumn("to", _bare(F.col("source")))
    longest = F.broadcast(goal.agg(F.coalesce(F.max(F.length("to")), F.lit(0)).alias("_most")))  # one row
    filed = names.select("filed").dropna().distinct().withColumn("from", _bare(F.col("filed")))
    filed = filed.crossJoin(longest).where(F.length("from") <= F.col("_most") + MOST_EDITS).drop("_most")
    short = lambda df, c: df.withColumn("key", F.explode(_shortened(F.col(c))))
    met = short(filed, "from").join(short(goal, "to"), "key").select("filed", "source", F.levenshtein("from", "to").alias("d")).where(F.col("d") <= MOST_EDITS)
    return met.groupBy("filed").agg(F.min(F.struct("d", "source"))["source"].alias("source"))


def flight(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase, balanced on count and size: at most two stay between 0 and 1.

    Three undecided units move along the direction that changes neither their number nor their
    size, as far as one of them comes to 0 or 1, up or down at random so that each keeps its
    probability; the next unit takes its place.
    """
    p = p.copy()
    waiting = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    waiting.reverse()
    held: list[int] = []
    draws = rng.random(3 * len(waiting) + 3).tolist()
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            return p
        a, b, c = held
        xa, xb, xc = float(x[a]), float(x[b]), float(x[c])
        u = (xb - xc, xc - xa, xa - xb) if not xa == xb == xc else (1.0, -1.0, 0.0)
        _move(p, held, u, draws.pop())
        held = [i for i in held if EPS < p[i] < 1 - EPS]


def _move(p: np.ndarray, held: list[int], u: tuple[float, ...], draw: float) -> None:
    up = min(((1 - p[i]) / d if d > 0 else -p[i] / d) for i, d in zip(held, u) if d)
    down = min((p[i] / d if d > 0 else (p[i] - 1) / d) for i, d in zip(held, u) if d)
    step = up if draw * (up + down) < down else -down
    for i, d in zip(held, u):
        v = p[i] + step * d
        p[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v


def landing(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The last undecided units of a source: two are moved against each other, one is drawn."""
    p = p.copy()
    held = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    while len(held) > 1:
        _move(p, held[:2], (1.0, -1.0), rng.random())
        held = [i for i in held if EPS < p[i] < 1 - EPS]
    for i in held:
        p[i] = float(rng.random() < p[i])
    return p


def _flyer(seed: int, round_: int, last: bool):
    def fly(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc")
        x, p = t["tokens"].to_numpy().astype(float), t["p"].to_numpy()
        rng = np.random.default_rng([seed, round_, t["part"][0].as_py(), *t["source"][0].as_py().encode()])
        p = flight(x, p, rng)
        if last:
            p = landing(x, p, rng)
        return pa.table([t["source"], t["doc"], t["tokens"], pa.array(p)], ["source", "doc", "tokens", "p"])

    return fly


def cube_sample(units: DataFrame, group: int = GROUP, seed: int = 23) -> DataFrame:
    """``units`` (source, doc, tokens, p) with p brought to 0 or 1, balanced in each source.

    Sources are strata. A round cuts each source by a hash into groups of about ``group`` units
    and flies each; at most two units of a group stay undecided and go on to the next round, where
    they are few enough for fewer groups. Each round keeps a source's count and size exactly; the
    landing, of at most two units a source, alone is off.
    """
    scratch = Scratch(units.sparkSession, "cube")
    done: list[DataFrame] = []
    state = scratch.keep(units.select("source", "doc", "tokens", "p"), "units")
    for round_ in range(MOST_ROUNDS):
        sizes = state.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        groups = sizes.select("source", F.ceil(F.col("n") / group).alias("groups"))
        most = groups.agg(F.max("groups")).first()[0] or 1
        last = most == 1

        cut = state.join(groups, "source").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(seed + round_)), F.col("groups")).cast("int")).drop("groups")
        flown = scratch.keep(cut.groupBy("source", "part").applyInArrow(_flyer(seed, round_, last), UNITS), "flown")
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~undecided))
        if last:
            break
        state = flown.where(undecided)
    else:
        raise RuntimeError(f"units are undecided after {MOST_ROUNDS} rounds")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def mixture(docs: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, tokenizer: str, total: float | None = None, seed: int = 23) -> DataFrame:
    """The documents of the mix: doc, source, tokens, copies (1 or more).

    The mix has ``total`` tokens, or by default the most that the sources allow when each is
    repeated as often as its ``max_repeats`` (null counts as 1). A source's documents are all used
    floor(f) times, f being its wanted over its own tokens, and once more with probability
    f - floor(f), drawn by ``cube_sample``. Source names are matched by ``true_sources``, each
    distinct name once; documents of no target source, without id or without tokens are not used.
    Repeated ids count once, by the delivery of most tokens. A target without usable documents,
    or without a positive share, gets nothing, and the others keep their proportions. Equal texts
    under several ids are documents of their own.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    goal = targets.where("target_share > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    counted = with_tokens(docs, doc_id, text, source, tokenizer).where("doc is not null and tokens > 0").groupBy("doc").agg(F.max(F.struct("tokens", "filed")).alias("x"))
    counted = scratch.keep(counted.select("doc", "x.tokens", "x.filed"), "counted")
    by_name = counted.where("filed is not null").groupBy("filed").agg(F.count(F.lit(1)).alias("_n"), F.sum("tokens").alias("_tokens"))
    names = scratch.keep(by_name.join(true_sources(by_name, goal), "filed"), "names")
    have = names.groupBy("source").agg(F.sum("_tokens").alias("tokens")).join(goal, "source")
    bound = have.agg(F.sum("share").alias("whole"), F.min(F.col("repeats") * F.col("tokens") / F.col("share")).alias("least")).first()
    most = (bound["least"] or 0.0) * (bound["whole"] or 0.0)
    size = most if total is None else min(total, most)
    times = F.lit(size) * F.col("share") / F.lit(bound["whole"] or 1.0) / F.col("tokens")
    base = F.floor(times + EPS)
    rates = have.select("source", base.cast("int").alias("base"), F.when(times - base > EPS, times - base).otherwise(F.lit(0.0)).alias("p"))
    rates = scratch.keep(names.select("filed", "source", "_n").join(rates, "source"), "rates")
    drawn = scratch.keep(join_unique(counted, rates, "filed").select("source", "doc", "tokens", "base", "p"), "drawn")
    chosen = cube_sample(drawn.where("p > 0").select("source", "doc", "tokens", "p"), seed=seed).where("p = 1").select("doc", F.lit(1).alias("once"))
    copies = drawn.join(chosen, "doc", "left").withColumn("copies", F.col("base") + F.coalesce("once", F.lit(0)))
    return copies.where("copies > 0").select("doc", "source", "tokens", F.col("copies").cast("int").alias("copies"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each source, with its documents, copies and tokens in the mix."""
    by = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = by.agg(F.sum("tokens").alias("_all"))
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").na.fill(0, ["n_docs", "n_copies", "tokens", "most_copies"])
    out = out.crossJoin(F.broadcast(whole))  # one row
    return out.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("_all")), F.lit(0.0))).drop("_all")
