"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of word shingles; texts with the same set are one class, kept once from here on.
2. A class has a signature of minima. Bands of it deal classes into buckets; each class of a bucket makes a pair with
   the bucket's pivot, so a bucket of n classes makes n - 1 pairs however large it is. What these pairs connect is a
   group: every pair of classes that shares a bucket lies within one.
3. Groups of more than one block: signatures of the pairs are compared in batches. After each one, pairs whose
   similarity reaches the threshold with less than the chosen miss probability, given the matches so far, are
   dropped. Survivors are verified on full sets, first the best of each class, then those not connected yet.
4. What is not connected yet is looked for in cells: a group that still holds several components, or those of its
   buckets that do, whichever sends fewer sets. The classes outside a cell's largest component are compared with all
   others that share a band, in blocks, and verified on full sets; only links that connect something leave a task.

Components come from alternating stars on the links. Intermediate tables are written to the shared folder, so work
is not repeated and lost executors cost their tasks only. Nothing is collected but counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.shared import remove, shared_dir
from spoor.llm.tokens import SPACES, U64, Spans, mix, mix_int, slices, words_of
from spoor.llm.workers import grouped, streaming

#: Values of a signature (16 bits each), and those of a band: 32 bands of 4 miss a pair of similarity 0.8 in 5e-8.
VALUES, BAND = 128, 4
#: Values that are compared before the next look at the posterior.
BATCH = 32
#: Classes of a group or bucket, and shingles of them, that make a block; two blocks are compared in one task.
BLOCK, BLOCK_SHINGLES = 256, 4_000_000
#: Pairs of one pivot that are verified together.
SALT = 256
#: Shingles of two blocks, and pairs, that are held as bits and verified at a time.
BITS, PAIRS = 1 << 16, 20_000

_SEEDS = np.array([mix_int(2 * i + 1) | 1 for i in range(VALUES)], dtype=U64)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, ascending within it, and where each text's begin.

    A text with fewer words than ``size``, but not none, has all of them as its one shingle.
    """
    words = words_of(column, SPACES, lower=True)
    counts = words.counts
    many = np.where(counts >= size, counts - (size - 1), np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), many)
    start = np.arange(len(text)) + np.repeat(words.first[:-1] - (np.cumsum(many) - many), many)
    found = Spans(words.hashes())(start, np.minimum(counts, size)[text])
    order = np.lexsort((found, text))
    found = found[order]
    new = np.r_[True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])] if len(found) else np.zeros(0, dtype=bool)
    return found[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def signatures(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of 16-bit minima for each text that has shingles."""
    begins = first[:-1][np.diff(first) > 0]
    out = np.empty((len(begins), VALUES), dtype=np.uint16)
    for i, seed in enumerate(_SEEDS):
        x = found * seed
        x ^= x >> U64(32)
        out[:, i] = np.minimum.reduceat((x * _SEEDS[-1 - i]) >> U64(32), begins).astype(np.uint16) if len(begins) else 0
    return out


def least_matches(n: int, similarity: float, miss: float) -> int:
    """The fewest matches among ``n`` values for which the similarity may reach the threshold.

    With any similarity as likely before, the posterior after m matches is Beta(m + 1, n - m + 1), of which the part
    from the threshold t on is P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, similarity: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signatures (rows of a and b) pass all batches, and their matches."""
    rows, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for upto in range(BATCH, VALUES + 1, BATCH):
        part = slice(upto - BATCH, upto)
        matches = matches + (a[rows, part] == b[rows, part]).sum(axis=1)
        keep = matches >= least_matches(upto, similarity, miss)
        rows, matches = rows[keep], matches[keep]
    return rows, matches


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets ``a[i]`` and ``b[i]`` share, by rows of bits over some shingles at a time."""
    used = np.unique(np.r_[a, b])
    place = np.zeros(len(sets), dtype=np.int64)
    place[used] = np.arange(len(used))
    a, b = place[a], place[b]
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, element = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    out = np.zeros(len(a), dtype=np.int64)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    for low in range(0, int(element[-1]) + 1 if len(element) else 0, BITS):
        x, z = np.searchsorted(element, [low, low + BITS])
        bits = np.zeros((len(used), BITS), dtype=bool)
        bits[owner[x:z], element[x:z] - low] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        for at in range(0, len(a), 2000):
            part = slice(at, at + 2000)
            out[part] += np.bitwise_count(packed[a[part]] & packed[b[part]]).sum(axis=1, dtype=np.int64)
    return out


class Forest:
    """Which labels are connected."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(
    sig: np.ndarray, sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray,
    similarity: float, miss: float,
) -> list[tuple[int, int]]:
    """Links between rows ``left`` and ``right`` of different labels that share a band, as many as connect what all connect."""
    size = np.array([len(s) for s in sets])
    percent = round(similarity * 100)
    bands = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), -1)
    found = []
    for x in left:
        others = right[(label[right] != label[x]) & (right != x)]
        others = others[(bands[others] == bands[x]).any(axis=1)]
        # Sets of sizes too far apart cannot be similar enough.
        others = others[100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])]
        rows, matches = surviving(np.broadcast_to(sig[x], (len(others), VALUES)), sig[others], similarity, miss)
        found.append((np.full(len(rows), x), others[rows], matches))
    a, b, m = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64) for k in range(3))
    order = np.argsort(-m, kind="stable")
    a, b, forest, out = a[order], b[order], Forest(), []
    while len(a):
        some, a, other, b = a[:PAIRS], a[PAIRS:], b[:PAIRS], b[PAIRS:]
        inter = intersections(sets, some, other)
        linked = 100 * inter >= percent * (size[some] + size[other] - inter)
        out += [
            (x, y) for x, y in zip(some[linked].tolist(), other[linked].tolist(), strict=True)
            if forest.join(int(label[x]), int(label[y]))
        ]
        roots = np.array([forest.root(int(v)) for v in label])
        open_ = roots[a] != roots[b]
        a, b = a[open_], b[open_]
    return out


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, VALUES)


class _Tables:
    """Tables written to the shared folder."""

    def __init__(self, spark, name: str):
        self.spark, self.path, self.made = spark, shared_dir(spark, name), 0

    def keep(self, df: DataFrame, name: str = "") -> DataFrame:
        self.made += 1
        path = f"{self.path}/{name or 'step'}-{self.made}"
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, first: int, last: int) -> None:
        """Deletes the unnamed tables from the ``first`` one to the ``last``, which no frame reads any longer."""
        for i in range(first, last + 1):
            remove(self.spark, f"{self.path}/step-{i}")


def components(links: DataFrame, tables: _Tables) -> DataFrame:
    """(node, label) of all nodes of links (a, b): label is the least node of the component, by alternating stars."""
    edges = tables.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, first = None, tables.made
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = tables.keep(small.select("e.a", "e.b").where("a <> b").distinct())
        tables.drop(first, tables.made - 1)
        first = tables.made
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, miss: float = 1e-6,
) -> DataFrame:
    """One row for each row of ``docs``: id (of any type with an order), text_hash long, n_shingles long, component_id, kept boolean.

    Texts whose sets of ``shingle``-word shingles have a Jaccard similarity of at least ``similarity`` are linked;
    component_id is the least id that links lead to, itself included, and kept tells whether it is the row's own.
    similarity counts in whole percent; miss: the probability with which a pair at the threshold may be dropped after each batch of signature values.
    A-Z are lower-cased; words stand between spaces and control characters of the same kind. A text with fewer words
    is one shingle. A null text, or one without words, has no shingles and is linked with nothing: it is kept, as
    its own component. A null id takes part in links but is never a component's id; such a row is kept only if it is
    linked with no id. Rows with equal ids are rows of their own; of equal texts under one id all are kept.
    """
    spark = docs.sparkSession
    tables = _Tables(spark, "near")
    percent = round(similarity * 100)
    frame = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    frame = frame.withColumn("th", F.xxhash64("text"))
    sketched = T.StructType([
        frame.schema["id"], T.StructField("th", T.LongType()), T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()),
        T.StructField("sig", T.BinaryType()),
    ])

    def sketch(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(1)):
                part = batch.slice(row, rows)
                found, first = shingles(part.column(1), shingle)
                full = np.diff(first) > 0
                sums = np.zeros((rows, 2), dtype=U64)
                begins = first[:-1][full]
                for k in (0, 1):
                    if len(begins):
                        sums[full, k] = np.add.reduceat(mix(found ^ U64(mix_int(991 + k))), begins)
                keys = [k.tobytes() if f else None for k, f in zip(sums, full, strict=True)]
                sigs = iter(signatures(found, first))
                sig = [next(sigs).tobytes() if f else None for f in full]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(np.diff(first), pa.int64()), pa.array(keys, pa.binary()), pa.array(sig, pa.binary())],
                    ["id", "th", "n", "key", "sig"],
                )

    all_ = tables.keep(frame.mapInArrow(streaming(sketch), sketched), "sketches")
    classes = all_.where("key IS NOT NULL").groupBy("key").agg(F.first("sig").alias("sig"), F.min("th").alias("th"), F.first("n").alias("n"))
    classes = tables.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    bands = F.transform(
        F.sequence(F.lit(0), F.lit(VALUES // BAND - 1)),
        lambda i: F.xxhash64(i, F.substring("sig", i * (2 * BAND) + 1, F.lit(2 * BAND))),
    )
    dealt = classes.select("node", F.explode(bands).alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    pairs = dealt.join(full, "bucket").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    pairs = tables.keep(pairs)
    groups = components(pairs, tables).withColumnRenamed("label", "g")
    groups = groups.join(classes.select("node", "th", "n", "sig"), "node")
    sizes = groups.groupBy("g").agg(F.count("*").alias("size"), F.sum("n").alias("held"))
    large = tables.keep(sizes.where((F.col("size") > BLOCK) | (F.col("held") > BLOCK_SHINGLES)).select("g"))

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows, matches = surviving(_signature_rows(batch.column(2)), _signature_rows(batch.column(3)), similarity, miss)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(matches)], ["a", "b", "m"]
            )

    # The sets of all classes of groups.
    texts = frame.groupBy("th").agg(F.first("text").alias("text")).join(groups.select("node", "g", "th", "sig"), "th")

    def sets_of(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(3)):
                part = batch.slice(row, rows)
                found, first = shingles(part.column(3), shingle)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists], ["node", "g", "sig", "s"])

    sets = tables.keep(
        texts.select("node", "g", "sig", "text").mapInArrow(streaming(sets_of), "node long, g long, sig binary, s array<long>")
    )

    def verified(some: DataFrame) -> DataFrame:
        """The links among pairs (a, b), by the sizes of intersection and union of their full sets.

        The pairs of a frequent b are dealt by salts, and b's set goes once to each.
        """
        many = some.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
        salted = some.select("a", "b").join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), "salts").cast("int"))
        one = salted.select("a", "b", "salt").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        other = sets.join(many.withColumnRenamed("b", "node"), "node").select(
            F.col("node").alias("b"), F.col("s").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        )
        two = one.join(other, ["b", "salt"])
        inter = F.size(F.array_intersect("sa", "sb"))
        union = F.size("sa") + F.size("sb") - inter
        return two.where(inter * 100 >= union * percent).select("a", "b")

    def labelled(df: DataFrame, labels: DataFrame, *ends: str) -> DataFrame:
        """With ``l<end>`` for each named end: its component so far, itself where it has no link."""
        for e in ends:
            df = df.join(labels.select(F.col("node").alias(e), F.col("label").alias(f"l{e}")), e, "left")
            df = df.withColumn(f"l{e}", F.coalesce(f"l{e}", e))
        return df

    # Groups of several blocks: the pairs with pivots first.
    labels = spark.createDataFrame([], "node long, label long")
    if not large.isEmpty():
        of = sets.join(large, "g").select("node", "sig")
        both = pairs.join(of.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(
            of.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"
        )
        likely = tables.keep(both.select("a", "b", "sa", "sb").mapInArrow(streaming(compare), "a long, b long, m long"))
        best = tables.keep(likely.groupBy("a").agg(F.max_by("b", F.struct("m", "b")).alias("b")))
        links = tables.keep(verified(best))
        labels = tables.keep(components(links, tables))
        rest = labelled(likely.join(best, ["a", "b"], "left_anti"), labels, "a", "b").where("la <> lb")
        links = tables.keep(links.unionAll(verified(rest)))
        labels = tables.keep(components(links, tables))

    # What is not connected yet, in cells: a whole group, or its buckets if fewer sets have to be sent for these.
    nodes = labelled(sets.select("node", "g", F.size("s").alias("held")), labels, "node").withColumnRenamed("lnode", "label")

    def mixed(members: DataFrame) -> DataFrame:
        """Cells with several labels: the commonest one, blocks of all members and of those with other labels, rows to send."""
        by = members.groupBy("cell", "g", "label").agg(F.count("*").alias("n"), F.sum("held").alias("held"))
        by = by.groupBy("cell", "g").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.max(F.struct("n", "held", "label")).alias("main"))
        blocks = lambda n, held: F.ceil(F.greatest(n / BLOCK, held / BLOCK_SHINGLES))
        rest = F.col("n") - F.col("main.n")
        right, left = blocks(F.col("n"), F.col("held")), blocks(rest, F.col("held") - F.col("main.held"))
        return by.where(rest > 0).select("cell", "g", F.col("main.label").alias("main"), right.alias("right"), left.alias("left"), (F.col("n") * left + rest * right).alias("rows"))

    cell = lambda of, bucket: F.struct(F.col(of).alias("of"), F.lit(bucket).alias("bucket")).alias("cell")
    in_groups = nodes.select(cell("g", False), "g", "node", "label", "held")
    groups_ = tables.keep(mixed(in_groups))
    in_buckets = dealt.join(nodes.join(groups_.select("g"), "g", "left_semi"), "node").select(cell("bucket", True), "g", "node", "label", "held")
    buckets = tables.keep(mixed(in_buckets))
    # A group of which no bucket holds two labels has no candidates.
    both = groups_.join(buckets.groupBy("g").agg(F.sum("rows").alias("in_buckets")), "g")
    whole = F.col("rows") <= F.col("in_buckets")
    cells = both.where(whole).select(*groups_.columns).unionAll(buckets.join(both.where(~whole).select("g"), "g", "left_semi").select(*groups_.columns))
    cells = tables.keep(cells.select("cell", "main", F.col("right").cast("int").alias("right"), F.col("left").cast("int").alias("left")))
    split = in_groups.unionAll(in_buckets).select("cell", "node", "label").join(cells, "cell")
    # Rows of other labels than the commonest are compared with all rows: a task has one block of either.
    spread = lambda mine, others: F.transform(F.sequence(F.lit(0), F.col(others) - 1), lambda x: F.struct(
        (F.pmod(F.xxhash64("node", F.lit(5)), F.col("right")).cast("int") if mine == "right" else x).alias("i"),
        (F.pmod(F.xxhash64("node", F.lit(6)), F.col("left")).cast("int") if mine == "left" else x).alias("j"), F.lit(mine == "left").alias("other"),
    ))
    roles = F.when(F.col("label") == F.col("main"), spread("right", "left")).otherwise(F.concat(spread("right", "left"), spread("left", "right")))
    split = split.select("cell", "node", "label", F.explode(roles).alias("x")).select("cell", "node", "label", "x.i", "x.j", "x.other")
    split = split.join(sets.select("node", "sig", "s"), "node")

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        sets_ = [np.asarray(s.values) for s in table["s"]]
        node, other = table["node"].to_numpy(), table["other"].to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(other), np.flatnonzero(~other)
        found = block_links(_signature_rows(table["sig"]), sets_, table["label"].to_numpy(), left, right, similarity, miss)
        ends = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[ends[:, 0]], pa.int64()), "b": pa.array(node[ends[:, 1]], pa.int64())})

    more = split.groupBy("cell", "i", "j").applyInArrow(grouped(block), "a long, b long")
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = tables.keep(components(known.unionAll(more), tables), "labels")
    tables.drop(1, tables.made)

    nodes = labelled(classes.select("node", "key"), labels, "node").select("key", F.col("lnode").alias("label"))
    by_class = all_.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least")).join(nodes, "key")
    least = by_class.groupBy("label").agg(F.min("least").alias("component"))
    of_key = by_class.join(least, "label").select("key", "component")
    out = all_.select("id", "th", "n", "key").join(of_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id), F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )


def deduplicate(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component of near-duplicates: that of the least id. All columns stay.

    Rows of one id and text count once. Documents without an id stay unless linked with one that has an id, but for
    equal texts, of which one stays. See :func:`near_duplicates` for the rest.
    """
    found = near_duplicates(docs, id=id, text=text, **options).toDF("i", "h", "n", "component", "kept").where("kept")
    found = _Tables(docs.sparkSession, "kept").keep(found.groupBy("i", "h").agg(F.count("*").alias("n")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id}`").alias("own"),
        F.xxhash64(F.col(f"`{text}`").cast("string")).alias("hash"),
    )
    out = rows.join(found, F.col("own").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")), "left_semi")
    if not found.where("n > 1").isEmpty():
        out = out.dropDuplicates(["own", "hash"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicates among all texts of ``documents``, with shingles of four words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).drop("text_hash")


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS h
  FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT a AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a, n
"""
