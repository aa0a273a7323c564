"""Toxicity by weak supervision.

1. Voters are made from a bounded sample of labelled rows: lexicons of whole words, and patterns of word beginnings of
   one length, that stand mostly in toxic texts; several of each, and one that votes clean where no term stands at all.
2. A generative label model estimates by EM, without the labels, how often each voter speaks in either class, and the
   correlations of voters within the classes: those that speak together beyond what the class explains, as a lexicon and
   a pattern of the same words do, count less by as much.
3. A linear classifier over hashed words and word beginnings is trained on the model's posterior labels. It gives
   the scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.blobs import pack, pieces, shard_cuts, unpack
from spoor.llm.learning import held_out, labelled_sample
from spoor.llm.shared import shared_dir
from spoor.llm.tokens import SPACES, U64, mix, mix_int, slices, words_of
from spoor.llm.workers import grouped, release, streaming

#: Beginnings of words, in bytes, that patterns look at; 0 is the whole word.
BEGINNINGS = (0, 4, 5, 6)

#: Least likelihood ratio of a term; by chance one in some million terms has it.
SURE = 24
#: Least log odds of a term that a voter speaks for; chosen by threefold cross-validation on rows that are not held out.
PRECISE = 3.0
#: Voters of each kind: lexicons, and patterns of each length of beginnings.
VOTERS = (8, 4, 4, 4)
#: The lowest bits of a term tell its kind, by place in BEGINNINGS.
_KIND = U64(3)


def term_hashes(column: pa.Array, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of each word and word beginning: words between spaces, A-Z lower-cased, outer ASCII punctuation off.

    A term is a hash of 38 bits and 2 bits for its kind. places: 24 more bits, the lower ones, tell the words before and after.
    """
    words = words_of(column, SPACES, lower=True)
    start, end = words.start.copy(), words.end.copy()
    for _ in range(3):
        start += (start < end - 1) & _EDGE[words.data[np.minimum(start, len(words.data) - 1)]]
        end -= (start < end - 1) & _EDGE[words.data[np.maximum(end - 1, 0)]]
    text = words.text_of
    around = np.zeros(len(words), dtype=U64)
    if places and len(words):
        near = words.hashes()
        around = mix(np.r_[U64(0), near[:-1]] ^ mix(np.r_[near[1:], U64(0)])) >> U64(40)
    texts, terms = [], []
    for kind, size in enumerate(BEGINNINGS):
        long = slice(None) if not size else np.flatnonzero(end - start > size)
        a, z = start[long], end[long]
        h = words.hashes(a, np.minimum(z, a + size) if size else z)
        texts.append(text[long])
        h = (mix(h ^ U64(mix_int(size))) >> U64(24)) & ~_KIND | U64(kind)
        terms.append((h << U64(24)) | around[long] if places else h)
    return np.concatenate(texts), np.concatenate(terms)


_EDGE = np.zeros(256, dtype=bool)
_EDGE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Model(NamedTuple):
    """terms: ascending term hashes; weights of a text that holds them; bias."""

    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        if len(self.terms):
            maybe = np.zeros(1 << 16, dtype=bool)
            maybe[self.terms >> U64(24)] = True
            for row, rows in slices(column):
                text, term = term_hashes(column.slice(row, rows))
                some = maybe[term >> U64(24)]
                text, term = text[some], term[some]
                place = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
                hit = self.terms[place] == term
                code = np.unique(text[hit] * len(self.terms) + place[hit])
                np.add.at(out, row + code // len(self.terms), self.weights[code % len(self.terms)])
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """The posterior of class 1 for each row of boolean votes (rows x voters), without labels.

    Each voter speaks at a rate of its own in either class. A voter's evidence is divided by the sum of its squared
    correlations with all voters within the classes, so voters that say the same count once. The rates start from
    the rows in which most voters for class 1 speak; the last voter speaks for class 0.
    """
    n, voters = votes.shape
    if not n:
        return np.zeros(0)
    v = votes.astype(float)
    posterior = np.where(v[:, :-1].any(axis=1), 0.9, 0.05)
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior])
        rate = (weight @ v + 0.5) / (weight.sum(axis=1, keepdims=True) + 1)
        rest = v - posterior[:, None] * rate[1] - (1 - posterior)[:, None] * rate[0]
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        shared = ((rest.T @ rest) / n / np.outer(spread, spread)) ** 2
        count = 1 / np.maximum(1, shared.sum(axis=0))
        on, off = np.log(rate[1] / rate[0]) * count, np.log((1 - rate[1]) / (1 - rate[0])) * count
        logit = np.log(prior / (1 - prior)) + v @ on + (1 - v) @ off
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - posterior).max() < 1e-4:
            return new
        posterior = new
    return posterior


def _weighed(clean: np.ndarray, toxic: np.ndarray, totals: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of terms, and their likelihood ratio against a term that stands in both classes alike."""
    all_clean, all_toxic = (max(1.0, float(n)) for n in totals)
    clean, toxic = clean.astype(float), toxic.astype(float)
    odds = np.log((toxic + 0.5) / all_toxic) - np.log((clean + 0.5) / all_clean)
    both = toxic + clean
    sure = 2 * sum(x * np.log(np.maximum(x, 1e-9) / (both * k / (all_toxic + all_clean))) for x, k in ((toxic, all_toxic), (clean, all_clean)))
    return odds, sure


def choose(sample: DataFrame, path: str, most: int) -> list:
    """(term, odds, sure) of the ``most`` surest terms, counted in shards by term; only these are collected.

    A term counts once for each place, that is for each pair of words around it, in either class: what stands in
    copies of one toxic text counts once, and a term that is toxic by itself stands in many places.
    """
    shards = pieces(sample, 8)

    def send(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(1)):
                text, term = term_hashes(batch.column(1).slice(row, rows), places=True)
                of = batch.column(2).slice(row, rows).to_numpy(zero_copy_only=False)[text]
                for y in (0, 1):
                    keys = np.unique(term[of == y])
                    cuts = shard_cuts(keys, shards)
                    parts = [(s, keys[a:z]) for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s for s, _ in parts], pa.int32()), pa.array([y] * len(parts), pa.int32()),
                            pa.array([len(k) for _, k in parts], pa.int32()), pa.array([pack([(k, 8)]) for _, k in parts], pa.binary()),
                        ],
                        ["shard", "y", "n", "blob"],
                    )

    def count(key: tuple, mail: pa.Table) -> pa.Table:
        sent = list(zip(*(mail[c].to_pylist() for c in ("y", "n", "blob")), strict=True))
        placed = [np.unique(np.concatenate([np.zeros(0, dtype=U64), *(unpack(blob, n, [8])[0] for y, n, blob in sent if y == k)])) >> U64(24) for k in (0, 1)]
        terms = np.unique(np.concatenate(placed))
        counts = [np.bincount(np.searchsorted(terms, p), minlength=len(terms)) for p in placed]
        blob = pack([(terms, 8), *((c, 5) for c in counts)])
        return pa.table({
            "n": pa.array([len(terms)], pa.int32()), "clean": [len(placed[0])], "toxic": [len(placed[1])], "blob": pa.array([blob], pa.binary()),
        })

    sent = sample.select("id", "text", "y").mapInArrow(streaming(send), "shard int, y int, n int, blob binary")
    sent.groupBy("shard").applyInArrow(grouped(count), "n int, clean long, toxic long, blob binary").write.parquet(f"{path}/counts")
    counted = sample.sparkSession.read.parquet(f"{path}/counts")
    total = counted.agg(F.sum("clean"), F.sum("toxic")).first()
    totals = (total[0] or 0, total[1] or 0)

    def surest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms, clean, toxic = unpack(blob, n, [8, 5, 5])
                odds, sure = _weighed(clean, toxic, totals)
                some = np.flatnonzero(sure > SURE)
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (terms.view(np.int64), odds, sure)], ["term", "odds", "sure"])

    some = counted.select("n", "blob").mapInArrow(streaming(surest), "term long, odds double, sure double")
    return some.orderBy(F.desc("sure"), "term").limit(most).collect()


def features(sample: DataFrame, terms: np.ndarray) -> pa.Table:
    """(id, y, held) of each text, in order of id: which of ``terms`` it holds, as 32-bit numbers."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(1)):
                text, term = term_hashes(batch.column(1).slice(row, rows))
                place = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                hit = terms[place] == term
                code = np.unique(text[hit] * len(terms) + place[hit])
                cuts = np.searchsorted(code, np.arange(rows + 1) * len(terms))
                held = (code % len(terms)).astype(np.int32)
                blobs = [held[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, rows), batch.column(2).slice(row, rows), pa.array(blobs, pa.binary())], ["id", "y", "held"]
                )

    schema = T.StructType([sample.schema["id"], T.StructField("y", T.IntegerType()), T.StructField("held", T.BinaryType())])
    return sample.select("id", "text", "y").mapInArrow(streaming(work), schema).toArrow().sort_by("id")


def fit(terms: np.ndarray, odds: np.ndarray, sure: np.ndarray, held: list[np.ndarray], y: np.ndarray, bias: float, *, steps: int = 300) -> Model:
    """A model from labelled texts.

    terms, odds, sure: the chosen terms, ascending, and what is known of them; held: the terms of each text, by
    number; y: its label; bias: log odds of class 1 among all labelled rows.
    """
    toxic, clean = int(y.sum()), int(len(y) - y.sum())
    owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
    feature = np.concatenate(held).astype(np.int64)
    # Voters: terms that stand mostly in toxic texts, the surest first, dealt to the voters of their kind.
    voters = sum(VOTERS)
    speaker = np.full(len(terms), -1)
    kind = (terms & _KIND).astype(np.int64)
    for k, (first, many) in enumerate(zip(np.cumsum((0, *VOTERS)), VOTERS, strict=False)):
        own = np.flatnonzero((odds > PRECISE) & (kind == k))
        own = own[np.argsort(-sure[own], kind="stable")]
        speaker[own] = first + np.arange(len(own)) % many
    votes = np.zeros((len(held), voters + 1), dtype=bool)
    speaks = speaker[feature] >= 0
    votes[owner[speaks], speaker[feature[speaks]]] = True
    votes[:, voters] = ~votes[:, :voters].any(axis=1)
    target = label_model(votes, toxic / len(y))
    # Logistic regression on the posterior labels, by gradient steps of adaptive size.
    weights, intercept, grown = np.zeros(len(terms)), 0.0, np.full(len(terms) + 1, 1e-6)
    for _ in range(steps):
        logit = np.bincount(owner, weights=weights[feature], minlength=len(held)) + intercept
        error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target
        slope = np.bincount(feature, weights=error[owner], minlength=len(terms)) + 0.3 * weights
        grown[:-1] += slope**2
        grown[-1] += error.sum() ** 2
        weights -= 0.5 * slope / np.sqrt(grown[:-1])
        intercept -= 0.5 * error.sum() / np.sqrt(grown[-1])
    # The sample has the classes in other shares than the table.
    shift = bias - float(np.log(toxic / clean))
    return Model(terms, weights, intercept + shift)


def train(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", target: str = "toxic",
    each: int = 2000, parts: int = 4, most: int = 20_000,
) -> Model:
    """Fits on at most ``each`` labelled rows of either class that are not held out.

    Their terms are counted in Spark; only the ``most`` surest terms, and which of them each text holds, are
    collected. With no row of one class, or no sure term, every score is the share of class 1 (0.5 without any).
    """
    sample, counts = labelled_sample(docs, labels, target, id=id, text=text, each=each, parts=parts)
    total = counts[0] + counts[1]
    share = min(max(counts[1] / total, 1e-3), 1 - 1e-3) if total else 0.5
    bias = float(np.log(share / (1 - share)))
    path = shared_dir(docs.sparkSession, "toxicity")
    sample.write.parquet(f"{path}/sample")
    sample = docs.sparkSession.read.parquet(f"{path}/sample")
    found = choose(sample, path, most) if sample.select("y").distinct().count() == 2 else []
    if not found:
        return Model(np.zeros(0, dtype=U64), np.zeros(0), bias)

    def fitted() -> Model:
        terms, odds, sure = (np.array(c) for c in zip(*found, strict=True))
        order = np.argsort(terms)
        terms = terms[order].astype(U64)
        got = features(sample, terms)
        held = [np.frombuffer(blob.as_py(), dtype=np.int32) for blob in got["held"]]
        return fit(terms, odds[order], sure[order], held, got["y"].to_numpy().astype(np.int64), bias)

    model = fitted()
    release()  # the driver goes on with other work
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3, keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` double (0 to 1) and ``predicted`` int (1 from ``threshold`` on).

    Whole texts are scored, of any length; a null or empty one gets the score of a text without any term. Nothing
    but the text enters. Columns of these names are replaced; rows keep their number. keep: the columns that stay; all.
    """
    rest = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("row"))
    schema = T.StructType([frame.schema["row"], T.StructField("score", T.DoubleType())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(0), 1 << 22):
                part = batch.slice(row, rows)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(model.scores(part.column(0)))], ["row", "score"])

    out = frame.mapInArrow(streaming(work), schema)
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in rest], "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of every text of ``documents``, learned from three quarters of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")
