"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes and word hashes of whole batches. Trees are grown here on the histograms of a bounded
sample, then flattened into arrays that all rows of a batch walk through together, one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.learning import held_out, labelled_sample
from spoor.llm.tokens import SPACES, Spans, Words, mix, slices, words_of
from spoor.llm.workers import streaming

STATISTICS = (
    "words", "bytes per word", "long words", "short words", "upper-case bytes", "upper-case words", "capitals", "digits",
    "full stops and commas", "exclamation marks", "symbols", "bars", "bytes beyond ASCII", "spaces", "words per line",
    "repeated lines", "words as the one before", "distinct words", "distinct windows of 3 words", "commonest word",
)


def _kinds(text: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(text.encode("latin-1"), dtype=np.uint8)] = True
    return out


_UPPER, _DIGIT, _STOP, _BANG = _kinds("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kinds("0123456789"), _kinds(".,"), _kinds("!")
_SYMBOL, _BAR, _HIGH = _kinds("#*$%&<>"), _kinds("|"), np.arange(256) > 127


def _distinct(text: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, how many different hashes it has and how often its commonest stands."""
    key = np.sort(mix(hashes ^ mix(text.astype(np.uint64))) >> np.uint64(24) | text.astype(np.uint64) << np.uint64(40))
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    owner = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(rows, dtype=np.int64)
    np.maximum.at(most, owner, np.diff(np.r_[first, len(key)]))
    return np.bincount(owner, minlength=rows), most


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics of each text, a row each; a null or empty text has zeros."""
    out = [np.zeros((0, len(STATISTICS)))]
    for row, rows in slices(column):
        w = words_of(column.slice(row, rows), SPACES)
        text, n = w.text_of, w.counts
        sizes = np.diff(w.offsets)
        per_word, per_byte = np.maximum(n, 1), np.maximum(sizes, 1)
        count = lambda table, w=w: np.diff(np.r_[0, np.cumsum(table[w.data])][w.offsets])
        each = lambda flags, text=text, rows=rows: np.bincount(text, weights=flags, minlength=rows)
        length = w.end - w.start
        first, second = w.data[w.start], w.data[np.minimum(w.start + 1, max(len(w.data) - 1, 0))] if len(w) else w.start
        hashes = w.hashes()
        same = np.r_[False, (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])][: len(hashes)]
        inner = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, dtype=np.int64)
        windows = Spans(hashes)(inner, 3) if len(inner) else hashes[:0]
        newline = np.zeros(256, dtype=bool)
        newline[10] = True
        lines = Words(w.data, w.offsets, newline)
        kinds, most = _distinct(text, hashes, rows)
        window_kinds, _ = _distinct(text[inner], windows, rows)
        line_kinds, _ = _distinct(lines.text_of, lines.hashes(), rows)
        n_lines = np.maximum(lines.counts, 1)
        out.append(
            np.stack(
                [
                    n, each(length) / per_word, each(length > 12) / per_word, each(length < 3) / per_word,
                    count(_UPPER) / per_byte, each(_UPPER[first] & _UPPER[second] & (length > 1)) / per_word, each(_UPPER[first]) / per_word,
                    count(_DIGIT) / per_byte, count(_STOP) / per_word, count(_BANG) / per_word, count(_SYMBOL) / per_word,
                    count(_BAR) / per_word, count(_HIGH) / per_byte, count(SPACES) / per_byte, n / n_lines,
                    (lines.counts - line_kinds) / n_lines, each(same) / per_word, kinds / per_word,
                    window_kinds / np.maximum(n - 2, 1), most / per_word,
                ],
                axis=1,
            )
        )
    return np.concatenate(out)


class Trees(NamedTuple):
    """Nodes of all trees: a row goes left if its statistic is at most the threshold; a leaf leads to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.bias), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                down = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float, *, trees: int = 60, depth: int = 4, bins: int = 64,
    rate: float = 0.2, least: float = 5.0, ridge: float = 1.0,
) -> Trees:
    """Boosted trees for the logistic loss, by second-order gains on histograms of ``bins`` quantiles."""
    bias = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
        logit = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-logit))
            slope, curve = weight * (p - y), weight * p * (1 - p)
            roots.append(len(nodes))
            nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
            open_ = [(roots[-1], np.arange(len(y)), 0)]
            while open_:
                node, rows, level = open_.pop()
                g, h = slope[rows].sum(), curve[rows].sum()
                best = (1e-6, -1, -1)
                if level < depth:
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        at = codes[rows, f]
                        gl = np.cumsum(np.bincount(at, weights=slope[rows], minlength=len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(at, weights=curve[rows], minlength=len(e) + 1))[:-1]
                        many = np.cumsum(np.bincount(at, minlength=len(e) + 1))[:-1]
                        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                        gain[(many < least) | (len(rows) - many < least)] = -1
                        if gain.max() > best[0]:
                            best = (float(gain.max()), f, int(gain.argmax()))
                if best[1] < 0:
                    nodes[node][4] = -rate * g / (h + ridge)
                    logit[rows] += nodes[node][4]
                    continue
                _, f, cut = best
                down = codes[rows, f] <= cut
                left, right = len(nodes), len(nodes) + 1
                nodes[node][:4] = [f, edges[f][cut], left, right]
                nodes += [[0, np.inf, left, left, 0.0], [0, np.inf, right, right, 0.0]]
                open_ += [(left, rows[down], level + 1), (right, rows[~down], level + 1)]
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    whole = [flat[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Trees(np.array(roots, dtype=np.int64), whole[0], flat[:, 1], whole[1], whole[2], flat[:, 4], depth, bias)


def train(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", target: str = "quality",
    each: int = 8000, parts: int = 4,
) -> Trees:
    """Fits on at most ``each`` labelled rows of either class that are not held out; only statistics are collected.

    Rows are weighted so that the classes have the shares they have in all labels. Without rows of one class every
    score is the share of class 1 (0.5 without any label).
    """
    sample, counts = labelled_sample(docs, labels, target, id=id, text=text, each=each, parts=parts)
    schema = T.StructType([sample.schema["id"], T.StructField("x", T.BinaryType()), T.StructField("y", T.IntegerType())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = [r.tobytes() for r in statistics(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["id", "x", "y"])

    got = sample.select("id", "text", "y").mapInArrow(streaming(work), schema).toArrow().sort_by("id")
    x = np.frombuffer(b"".join(got["x"].to_pylist()), dtype=float).reshape(-1, len(STATISTICS))
    y = got["y"].to_numpy().astype(np.int64)
    total = counts[0] + counts[1]
    share = min(max(counts[1] / total, 1e-3), 1 - 1e-3) if total else 0.5
    drawn = np.maximum(np.bincount(y, minlength=2), 1)
    weight = np.array([(1 - share) / drawn[0], share / drawn[1]])[y] * max(len(y), 1)
    return grow(x, y, weight, share)


def score(docs: DataFrame, trees: Trees, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` double (0 to 1) and ``predicted`` int (1 from ``threshold`` on).

    Whole texts are scored, of any length; null and empty texts have statistics of zero. Nothing but the text
    enters. Columns of these names are replaced; rows keep their number.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    schema = T.StructType([frame.schema["row"], T.StructField("score", T.DoubleType())])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(0), 1 << 22):
                part = batch.slice(row, rows)
                found = trees.scores(statistics(part.column(0)))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(found)], ["row", "score"])

    out = frame.mapInArrow(streaming(work), schema)
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in rest], "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of every text of ``documents``, learned from three quarters of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", "predicted")
