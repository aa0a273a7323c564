"""An interpolated modified Kneser-Ney model of n-grams, counted in Spark and kept as sorted hash arrays.

Words are known by 64-bit hashes. The vocabulary is a sorted array of hashes in shards, and a word's number is its
rank. Longer n-grams are hashes of numbers in sorted tables (:mod:`spoor.llm.grams`). Workers map the arrays into memory.

1. Words: each partition sends sorted hashes and counts to shards by hash range; a shard writes its array.
2. n-grams of the model's order: the same, dealt by their middle words, so that what stands before and after a middle
   is in one shard. A middle of words that are all as common as a quarter of a shard is dealt by the whole n-gram; there
   are at most four such words a shard, so their list is bounded.
3. Each shard writes its table, adds up what follows each context, and sends each n-gram without its first word to the
   next lower order, whose count is the number of words that it stands after. An n-gram at a text's begin has no word
   before it and keeps its own count. Contexts of common middles, which several shards know in part, go through one more
   exchange. A context that is followed once is not written: the lower order's table holds it already.
4. Shards of pairs tell how often words follow and are followed, by word; sums over all give the discounts.
5. Every text is scored against the mapped arrays.

Nothing of the corpus is collected but a few numbers for each shard. Files are written whole under another name and
moved, so a task that is run again leaves the same files.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.blobs import pieces
from spoor.llm.grams import Table, by_shard, coded, decoded, gram_hash, pack, route, save_table, summed, unpack
from spoor.llm.learning import held_out
from spoor.llm.shared import load_many, release_shuffles, save_many, shared_dir
from spoor.llm.tokens import SPACES, U64, Words, mix_int, slices, words_of
from spoor.llm.workers import grouped, streaming

#: Stands for the end of a text; no word is hashed to it but by chance.
END = mix_int(0xE0F)
#: Distinct keys that a worker holds before it sends them.
HELD = 2_000_000
#: MB of compressed input for each shard.
SHARD_MB = 16
#: Tables of a model that a worker keeps mapped.
OPEN = 4096
_MAIL = "kind string, shard int, n int, blob binary"
#: How often a context is followed, and by how many words once, twice, and more often.
AFTER = ("all", "once", "twice", "more")


class Model(NamedTuple):
    """Where the arrays are, and what holds for all of them.

    edges: the first word number of each vocabulary shard, and the number of words; tokens: training tokens; hot: numbers
    of common words; shards: of tables; held: names of the tables that were written; types: distinct pairs; discounts: of
    counts 0, 1, 2, 3 and more, for each order from 1 on; spare: what the lowest order keeps for words unseen.
    """

    path: str
    order: int
    edges: np.ndarray
    tokens: int
    hot: np.ndarray
    shards: int
    held: frozenset[str]
    types: int
    discounts: list[np.ndarray]
    spare: float


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each text's words and its end, and where each text begins."""
    first = words.first + np.arange(len(words.first))
    out = np.full(len(words) + len(first) - 1, END, dtype=U64)
    out[np.arange(len(words)) + words.text_of] = words.hashes()
    return out, first


def _hash_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    return np.r_[np.searchsorted(keys, np.array([(i << 64) // shards for i in range(shards)], dtype=U64)), len(keys)]


class Vocabulary:
    """Word numbers, and columns of counts by word number, from the mapped arrays."""

    def __init__(self, path: str, edges: np.ndarray):
        self.path, self.edges, self.shards = path, edges, len(edges) - 1
        self.open: dict[str, list[dict[str, np.ndarray]]] = {}

    def _files(self, name: str) -> list[dict[str, np.ndarray]]:
        if name not in self.open:
            self.open[name] = [load_many(f"{self.path}/{name}-{s}.npy") for s in range(self.shards)]
        return self.open[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of ascending hashes; -1 for a word that was not seen."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        cuts = _hash_cuts(hashes, self.shards)
        for s, file in enumerate(self._files("words")):
            a, z, own = cuts[s], cuts[s + 1], file["hash"]
            if z > a and len(own):
                place = np.minimum(np.searchsorted(own, hashes[a:z]), len(own) - 1)
                out[a:z] = np.where(own[place] == hashes[a:z], self.edges[s] + place, -1)
        return out

    def counts(self, file: str, name: str, numbers: np.ndarray) -> np.ndarray:
        """Of word numbers in any order; 0 for those below 0."""
        out = np.zeros(len(numbers), dtype=np.int64)
        order = np.argsort(numbers, kind="stable")
        order = order[np.searchsorted(numbers[order], 0) :]
        cuts = np.searchsorted(numbers[order], self.edges)
        cuts[-1] = len(order)  # the mark of a begin is the last shard's
        for s, arrays in enumerate(self._files(file)):
            rows = order[cuts[s] : cuts[s + 1]]
            if len(rows):
                out[rows] = decoded(arrays, name, numbers[rows] - self.edges[s])
        return out


def _grams(numbers: np.ndarray, first: np.ndarray, order: int, words: int) -> list[np.ndarray]:
    """For each token, the ``order - 1`` before it and itself.

    Before a text stand the mark ``words`` and, before that, ``words + 1``, which makes an n-gram none of this order.
    """
    lead, texts = order - 1, len(first) - 1
    place = np.arange(len(numbers)) + np.repeat(lead * np.arange(1, texts + 1), np.diff(first))
    row = np.full(len(numbers) + lead * texts, words + 1, dtype=np.int64)
    row[place] = numbers
    if lead:
        row[first[:-1] + lead * np.arange(1, texts + 1) - 1] = words
    return [row[place - lead + i] for i in range(order)]


def _common(columns: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """Whether the middle words of each row are common ones, as those of a pair, which has none, are."""
    out = np.ones(len(columns[0]), dtype=bool)
    for c in columns[1:-1]:
        place = np.minimum(np.searchsorted(hot, c), max(len(hot) - 1, 0))
        out &= hot[place] == c if len(hot) else False
    return out


def _dealt(columns: list[np.ndarray], hashes: np.ndarray, common: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram: by its middle, or for a common middle by all of it."""
    out = route(hashes, shards)
    if len(columns) > 2:
        out = np.where(common, out, route(gram_hash(columns[1:-1]), shards))
    return out.astype(np.int64)


def _letters(kind: str, shard: np.ndarray, shards: int, columns: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
    """Rows of mail: what goes to each shard."""
    order, cuts = by_shard(shard, shards)
    runs = [(s, order[a:z]) for s, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if z > a]
    return [(kind, s, len(rows), pack([c[rows] for c in columns], [v[rows] for v in values])) for s, rows in runs]


def _mail(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))]


def _read(mail: pa.Table, columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [unpack(b.as_py(), n.as_py(), columns, values) for b, n in zip(mail["blob"], mail["n"], strict=True)]
    return tuple([np.concatenate(side) for side in zip(*(p[k] for p in parts), strict=True)] for k in (0, 1))


def _discounts(n: list[int]) -> np.ndarray:
    """Of counts 0, 1, 2, and 3 and more, from how many keys are counted once to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    wanted = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(wanted, 1))])


def _after(hashes: np.ndarray, columns: list[np.ndarray], count: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of contexts with the counts of what follows them: each context once, with the values of ``AFTER``."""
    return summed(hashes, columns, [count, *((hit.astype(np.int64) for hit in (count == 1, count == 2, count > 2)))])


class _Held:
    """n-grams with counts, combined before they are sent."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, columns: list[np.ndarray]) -> bool:
        """True if it is time to send."""
        self.parts.append((hashes, columns, [np.ones(len(hashes), dtype=np.int64)]))
        self.size += len(hashes)
        if self.size > HELD:
            self._combine()
            return self.size > HELD // 2
        return False

    def _combine(self) -> None:
        hashes, columns, counts = zip(*self.parts, strict=True)
        join = lambda many: [np.concatenate(c) for c in zip(*many, strict=True)]
        self.parts = [summed(np.concatenate(hashes), join(columns), join(counts))]
        self.size = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray] | None:
        """Ascending distinct hashes with their columns and counts; None if there are none."""
        if not self.parts:
            return None
        self._combine()
        hashes, columns, (count,) = self.parts[0]
        self.__init__()
        return hashes, columns, count


def train(texts: DataFrame, *, text: str = "text", order: int = 3) -> Model:
    """Counts all n-grams of a column up to ``order`` words (2 to 8) and writes the model to the shared folder.

    A null text counts as empty; every text ends with one end token. Refuses more than 2**32 - 2 distinct words.
    """
    if not 2 <= order <= 8:
        raise ValueError(f"order {order}; models are of order 2 to 8")
    spark = texts.sparkSession
    frame = texts.select(F.col(f"`{text}`").cast("string").alias("text"))
    path, shards = shared_dir(spark, "ngrams"), pieces(frame, SHARD_MB)

    def send_words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()

        def sent() -> Iterator[pa.RecordBatch]:
            if (got := held.take()) is not None:
                key, _, count = got
                cuts = _hash_cuts(key, shards)
                rows = [
                    ("words", s, int(z - a), pack([key[a:z] & U64(0xFFFFFFFF), key[a:z] >> U64(32)], [count[a:z]]))
                    for s, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if z > a
                ]
                yield pa.RecordBatch.from_arrays(_mail(rows), names)

        for batch in stream:
            for row, rows in slices(batch.column(0)):
                tokens, _ = _tokens(words_of(batch.column(0).slice(row, rows), SPACES, lower=True))
                if held.add(tokens, []):
                    yield from sent()
        yield from sent()

    names = ["kind", "shard", "n", "blob"]

    def write_words(key: tuple, mail: pa.Table) -> pa.Table:
        (low, high), counts = _read(mail, 2, 1)
        hashes, _, (count,) = summed(high.astype(U64) << U64(32) | low, [], counts)
        save_many(f"{path}/words-{key[0].as_py()}.npy", {"hash": hashes} | coded("count", count))
        ends = int(count[hashes == U64(END)].sum())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": [len(hashes)], "tokens": [int(count.sum())], "texts": [ends]})

    told = frame.mapInArrow(streaming(send_words), _MAIL).groupBy("shard").applyInArrow(grouped(write_words), "shard int, n long, tokens long, texts long")
    found = {r["shard"]: r for r in told.collect()}
    for s in set(range(shards)) - set(found):
        save_many(f"{path}/words-{s}.npy", {"hash": np.zeros(0, dtype=U64)} | coded("count", np.zeros(0, dtype=np.int64)))
    edges = np.r_[0, np.cumsum([found[s]["n"] if s in found else 0 for s in range(shards)])].astype(np.int64)
    words, tokens, ends = int(edges[-1]), sum(r["tokens"] for r in found.values()), sum(r["texts"] for r in found.values())
    if words >= 2**32 - 2:
        raise ValueError(f"{words} distinct words; up to 2**32 - 3 fit into a number")

    common = tokens / (4 * shards)

    def hot_words(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for s in batch.column(0).to_pylist():
                arrays = load_many(f"{path}/words-{s}.npy")
                some = np.flatnonzero(decoded(arrays, "count", np.arange(len(arrays["hash"]))) > common) + edges[s]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64())], ["word"])

    many = spark.range(shards).repartition(max(1, shards // 16)).mapInArrow(hot_words, "word long")
    hot = np.array(sorted([r["word"] for r in many.collect()] + ([words] if ends > common else [])), dtype=np.uint32)

    def send_grams(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, held = Vocabulary(path, edges), _Held()

        def sent() -> Iterator[pa.RecordBatch]:
            if (got := held.take()) is not None:
                hashes, columns, count = got
                shard = _dealt(columns, hashes, _common(columns, hot), shards)
                yield pa.RecordBatch.from_arrays(_mail(_letters(f"gram{order}", shard, shards, columns, [count])), names)

        for batch in stream:
            for row, rows in slices(batch.column(0)):
                tokens, first = _tokens(words_of(batch.column(0).slice(row, rows), SPACES, lower=True))
                kinds, which = np.unique(tokens, return_inverse=True)
                number = vocabulary.numbers(kinds)
                if (number < 0).any():
                    raise RuntimeError("a training text has changed between the stages")
                columns = [c.astype(np.uint32) for c in _grams(number[which], first, order, words)]
                if held.add(gram_hash(columns), columns):
                    yield from sent()
        yield from sent()

    def write_grams(k: int):
        """For n-grams of ``k`` words: writes a shard's table, and tells contexts and lower orders of it."""

        def work(key: tuple, mail: pa.Table) -> pa.Table:
            s = key[0].as_py()
            columns, (count,) = _read(mail, k, 1)
            hashes, columns, (count,) = summed(gram_hash(columns), columns, [count])
            real = columns[0] <= words
            seen, own = count[real], [c[real] for c in columns]
            save_table(f"{path}/gram{k}-{s}.npy", hashes[real], {"count": seen})
            sums = np.array([len(seen), *(int((seen == i).sum()) for i in (1, 2, 3, 4))])
            rows = [(f"sums{k}", s, len(sums), pack([np.arange(len(sums))], [sums]))]
            if k == 2:
                context, (first,), after = _after(own[0].astype(U64), [own[0]], seen)
                rows += _letters("after", np.searchsorted(edges[1:-1], first, side="right"), shards, [first], after)
                _, (second,), follows = summed(own[1].astype(U64), [own[1]], [np.ones(len(seen), dtype=np.int64)])
                rows += _letters("follows", np.searchsorted(edges[1:-1], second, side="right"), shards, [second], follows)
            else:
                part = _common(own, hot)
                whole = [c[~part] for c in own[:-1]]
                context, _, after = _after(gram_hash(whole), [], seen[~part])
                some = after[0] > 1
                save_table(f"{path}/context{k}-{s}.npy", context[some], {n: v[some] for n, v in zip(AFTER, after, strict=True)})
                several = [c[part] for c in own[:-1]]
                context, several, after = _after(gram_hash(several), several, seen[part])
                rows += _letters(f"context{k}", route(context, shards), shards, several, after)
                lower, shorter, (stands,) = summed(gram_hash(columns[1:]), columns[1:], [np.where(real, 1, count)])
                rows += _letters(f"gram{k - 1}", _dealt(shorter, lower, _common(shorter, hot), shards), shards, shorter, [stands])
            return pa.Table.from_arrays(_mail(rows), names)

        return work

    def write_contexts(k: int):
        def work(key: tuple, mail: pa.Table) -> pa.Table:
            s = key[0].as_py()
            columns, values = _read(mail, k - 1, len(AFTER))
            context, _, after = summed(gram_hash(columns), [], values)
            some = after[0] > 1
            save_table(f"{path}/common{k}-{s}.npy", context[some], {n: v[some] for n, v in zip(AFTER, after, strict=True)})
            return pa.table({"shard": pa.array([s], pa.int32())})

        return work

    held: set[str] = set()
    discounts: dict[int, np.ndarray] = {}
    types = 0
    mailed = frame.mapInArrow(streaming(send_grams), _MAIL)
    for k in range(order, 1, -1):
        mailed.groupBy("shard").applyInArrow(grouped(write_grams(k)), _MAIL).write.parquet(f"{path}/told-{k}")
        told = spark.read.schema(_MAIL).parquet(f"{path}/told-{k}")
        sums = [(r["shard"], unpack(r["blob"], r["n"], 1, 1)[1][0]) for r in told.where(F.col("kind") == f"sums{k}").collect()]
        held |= {f"gram{k}-{s}" for s, _ in sums} | ({f"context{k}-{s}" for s, _ in sums} if k > 2 else set())
        total = np.sum([x for _, x in sums], axis=0, dtype=np.int64) if sums else np.zeros(5, dtype=np.int64)
        discounts[k], types = _discounts(total[1:].tolist()), int(total[0])
        if k > 2:
            of = told.where(F.col("kind") == f"context{k}").groupBy("shard").applyInArrow(grouped(write_contexts(k)), "shard int")
            held |= {f"common{k}-{r['shard']}" for r in of.collect()}
        mailed = told.where(F.col("kind") == f"gram{k - 1}")
        release_shuffles(spark)

    def write_words_after(key: tuple, mail: pa.Table) -> pa.Table:
        s = key[0].as_py()
        low = int(edges[s])
        n = int(edges[s + 1]) - low + (s == shards - 1)
        out = {name: np.zeros(n, dtype=np.int64) for name in (*AFTER, "follows")}
        for kind, size, blob in zip(*(mail[c].to_pylist() for c in ("kind", "n", "blob")), strict=True):
            (own,), values = unpack(blob, size, 1, len(AFTER) if kind == "after" else 1)
            for name, value in zip(AFTER if kind == "after" else ("follows",), values, strict=True):
                out[name][own.astype(np.int64) - low] += value
        save_many(f"{path}/after-{s}.npy", {k: v for name, values in out.items() for k, v in coded(name, values).items()})
        follows = out["follows"]
        return pa.table({"shard": pa.array([s], pa.int32())} | {f"s{i}": [int((follows == i).sum()) if i else int((follows > 2).sum())] for i in range(5)})

    five = ", ".join(f"s{i} long" for i in range(5))
    words_after = told.where("kind IN ('after', 'follows')").groupBy("shard").applyInArrow(grouped(write_words_after), f"shard int, {five}")
    by = {r["shard"]: r for r in words_after.collect()}
    for s in set(range(shards)) - set(by):
        none = np.zeros(int(edges[s + 1] - edges[s]) + (s == shards - 1), dtype=np.int64)
        save_many(f"{path}/after-{s}.npy", {k: v for name in (*AFTER, "follows") for k, v in coded(name, none).items()})
    n = [sum(r[f"s{i}"] for r in by.values()) for i in range(5)]
    discounts[1] = low = _discounts(n[1:])
    spare = (low[1] * n[1] + low[2] * n[2] + low[3] * n[0]) / types if types else 1.0
    release_shuffles(spark)
    return Model(path, order, edges, tokens, hot, shards, frozenset(held), types, [discounts[k] for k in range(1, order + 1)], spare)


class Scorer:
    """Scores texts against the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.words = int(model.edges[-1])
        self.vocabulary = Vocabulary(model.path, model.edges)
        self.open: dict[str, Table] = {}

    def _table(self, name: str) -> Table | None:
        """A table, mapped when it is first wanted; None if nothing was written. The oldest of too many is closed."""
        if name not in self.model.held:
            return None
        if name not in self.open:
            if len(self.open) >= OPEN:
                del self.open[next(iter(self.open))]
            self.open[name] = Table(f"{self.model.path}/{name}.npy")
        return self.open[name]

    def _found(self, name: str, shard: np.ndarray, hashes: np.ndarray, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is held, and its values in the columns."""
        hit, out = np.zeros(len(hashes), dtype=bool), np.zeros((len(columns), len(hashes)), dtype=np.int64)
        order, cuts = by_shard(shard, self.model.shards)
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if (table := self._table(f"{name}-{s}")) is not None:
                rows = order[cuts[s] : cuts[s + 1]]
                at = table.find(hashes[rows])
                rows, at = rows[at >= 0], at[at >= 0]
                hit[rows] = True
                for value, column in zip(out, columns, strict=True):
                    value[rows] = table.counts(column, at)
        return hit, out

    def _contexts(self, columns: list[np.ndarray]) -> np.ndarray:
        """The values of ``AFTER`` for contexts that were seen: n-grams without their last word."""
        k, shards = len(columns), self.model.shards
        hashes, common = gram_hash(columns[:-1]), _common(columns, self.model.hot)
        out = np.zeros((len(AFTER), len(hashes)), dtype=np.int64)
        out[:2] = 1  # what is not written is followed once
        for name, rows, key in (("context", ~common, columns[1:-1]), ("common", common, columns[:-1])):
            rows = np.flatnonzero(rows)
            if len(rows):
                hit, found = self._found(f"{name}{k}", route(gram_hash([c[rows] for c in key]), shards), hashes[rows], AFTER)
                out[:, rows[hit]] = found[:, hit]
        return out

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """For each text: tokens, known tokens, add-one score, model score (log10)."""
        m, v = self.model, self.vocabulary
        tokens, first = _tokens(words_of(column, SPACES, lower=True))
        kinds, which = np.unique(tokens, return_inverse=True)
        kinds = v.numbers(kinds)
        count, follows = v.counts("words", "count", kinds), v.counts("after", "follows", kinds)
        base = np.log10((count + 1) / (m.tokens + self.words + 1))
        lowest = np.full(len(kinds), m.spare / (self.words + 1))
        if m.types:
            lowest += np.maximum(follows - m.discounts[0][np.minimum(follows, 3)], 0) / m.types
        chance = lowest[which]
        number = kinds[which]
        grams = _grams(number, first, m.order, self.words)
        # What follows a word or a begin; a word that was not seen, or only at ends, is no context.
        both = np.r_[kinds, self.words]
        after = np.stack([v.counts("after", name, both) for name in AFTER])
        before = np.empty_like(which)
        before[1:] = which[:-1]
        before[first[:-1]] = len(kinds)
        seen = np.zeros(0, dtype=np.int64)
        for k in range(2, m.order + 1):
            if k == 2:
                some = np.flatnonzero(after[0][before] > 0)
                told = after[:, before[some]]
            else:
                # The context ends one token earlier, in the same text; it was seen if that n-gram was.
                some = np.flatnonzero(np.r_[False, seen[:-1] > 0][: len(number)] & (grams[-k] <= self.words) & (grams[-k] >= 0))
                told = self._contexts([g[some].astype(np.uint32) for g in grams[-k:]])
            discount = m.discounts[k - 1]
            got = np.zeros(len(some), dtype=np.int64)
            known = np.flatnonzero(number[some] >= 0)
            own = [g[some[known]].astype(np.uint32) for g in grams[-k:]]
            hashes = gram_hash(own)
            _, found = self._found(f"gram{k}", _dealt(own, hashes, _common(own, m.hot), m.shards), hashes, ("count",))
            got[known] = found[0]
            rest = (discount[1:] @ told[1:]) / told[0]
            chance[some] = np.maximum(got - discount[np.minimum(got, 3)], 0) / told[0] + rest * chance[some]
            seen = np.zeros(len(number), dtype=np.int64)
            seen[some] = got
        logs = np.log10(np.maximum(chance, 1e-300))
        add = lambda values: np.diff(np.r_[0, np.cumsum(values)][first])
        return [np.diff(first), add((count > 0)[which]), _sums(base[which], first), _sums(logs, first)]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of each text's values by themselves, so that a text's score does not depend on its neighbours."""
    return np.add.reduceat(values, first[:-1]) if len(first) > 1 else np.zeros(0)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens long, base_score and score double (log10 of whole texts).

    A-Z are lower-cased; words stand between spaces and control characters of the same kind. A text's end is one more token, so the perplexity is ``10 ** (-score / n_tokens)``. A null text counts
    as empty. Columns of these names are replaced; rows keep their number.
    """
    new = ("n_tokens", "n_known", "base_score", "score")
    rest = [c for c in docs.columns if c not in (*new, "train_tokens")]
    frame = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    kinds = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([frame.schema["row"], *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in stream:
            for row, rows in slices(batch.column(0), 1 << 22):
                part = batch.slice(row, rows)
                yield pa.RecordBatch.from_arrays([part.column(1), *(pa.array(x) for x in scorer(part.column(0)))], ["row", *new])

    out = frame.mapInArrow(streaming(work), schema)
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in rest], "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every text of ``documents``, learned from six sevenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), 7))
    return score(docs, train(docs.where("NOT held_out"))).drop("text")
