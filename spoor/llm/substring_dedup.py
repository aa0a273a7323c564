"""Substring dedup by recompression.

Words of a document that an earlier document (of smaller id) already has in a passage of ``window`` words or more are
removed. Documents are dealt into batches. Rounds of run and pair naming (:mod:`spoor.llm.recompression`) give every batch
symbols that are equal wherever the text is; each window is found by one symbol within it, and neighbouring windows
with the same symbol form a group, about 0.2 groups a word.

1. *Reveal.* Batches send the distinct (symbol, content of the group) with their least document to shards by symbol.
2. *Verify.* A shard tells each batch, in two bits a group, whether a smaller document has the same content, and
   whether the symbol also stands in other content, so that single windows may still be shared.
3. Only windows of the latter, where repeats begin or end, are exchanged one by one and judged in the same way.
4. Batches join the covered words and cut them out.

The exchange of a group costs some 14 bytes and its answer two bits. A symbol that stands in a third of all documents
is sent once by each batch, so no shard holds more of it than there are batches. Everything is one lazy plan whose
shuffles Spark can rebuild; nothing is collected or broadcast. From some 150 GB of input on, mail goes in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.blobs import pack, pieces, shard_cuts, unpack
from spoor.llm.recompression import Groups, window_groups
from spoor.llm.tokens import SPACES, U64, Spans, Words, buffers, slices, words_of
from spoor.llm.workers import grouped, streaming

MAIL = "shard int, batch int, n int, blob binary"
ANSWER = "batch int, shard int, kind int, n int, blob binary"
_WIDTHS = [8, 6, 8]
#: Rows of mail that go straight from batches to shards: some 150 GB of input.
MAIL_ROWS = 1 << 26
_NO_ANSWERS = pa.table({
    "batch": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "n": pa.array([], pa.int32()),
    "blob": pa.array([], pa.binary()),
})
_LOW48, _LOW32 = U64((1 << 48) - 1), U64((1 << 32) - 1)


class Part(NamedTuple):
    """Some texts of a batch: their words, ids, and the window groups of texts with an id."""

    words: Words
    row: int
    rows: int
    groups: Groups
    spans: Spans
    doc: np.ndarray


class Entries(NamedTuple):
    """Distinct (key, content) in ascending order with their least document; of: the entry of each input row."""

    key: np.ndarray
    content: np.ndarray
    least: np.ndarray
    of: np.ndarray


def _entries(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> Entries:
    order = np.lexsort((doc, content, key))
    k, c = key[order], content[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])] if len(k) else np.zeros(0, dtype=bool)
    of = np.empty(len(k), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return Entries(k[new], c[new], doc[order][new], of)


def _parts(ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int, levels: int) -> list[Part]:
    column = texts.combine_chunks()
    known = ~np.asarray(ids.is_null().combine_chunks().to_numpy(zero_copy_only=False))
    doc = ids.fill_null(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for row, rows in slices(column):
        words = words_of(column.slice(row, rows), SPACES)
        groups, spans = window_groups(words.hashes(), words.first, window, levels)
        keep = known[row : row + rows][groups.text]
        groups = Groups(*(x[keep] for x in groups))
        out.append(Part(words, row, rows, groups, spans, doc[row : row + rows][groups.text]))
    return out


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype=kind)


def _group_entries(parts: list[Part]) -> Entries:
    return _entries(
        _joined([p.groups.anchor for p in parts], U64),
        _joined([p.groups.content & _LOW48 for p in parts], U64),
        _joined([p.doc for p in parts], np.int64),
    )


def _mail(batch: int, entries: Entries, shards: int) -> pa.Table:
    cuts = shard_cuts(entries.key, shards)
    rows = [(s, a, z) for s, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if z > a]
    blobs = [
        pack([(entries.key[a:z], 8), (entries.content[a:z], 6), (entries.least[a:z], 8)]) for _, a, z in rows
    ]
    return pa.table({
        "shard": pa.array([s for s, _, _ in rows], pa.int32()),
        "batch": pa.array([batch] * len(rows), pa.int32()),
        "n": pa.array([z - a for _, a, z in rows], pa.int32()),
        "blob": pa.array(blobs, pa.binary()),
    })


def _opened(mail: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Batches and sizes of mail in order of batches, and all keys, contents and documents."""
    mail = mail.sort_by("batch")
    ns, batches = mail["n"].to_pylist(), mail["batch"].to_pylist()
    parts = [unpack(b.as_py(), n, _WIDTHS) for b, n in zip(mail["blob"], ns, strict=True)]
    key, content = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return batches, ns, key, content, np.concatenate([p[2] for p in parts]).view(np.int64)


def _told(kind: int, shard: int, batches: list[int], ns: list[int], smaller: np.ndarray, mixed: np.ndarray) -> pa.Table:
    """Answers to batches, two bits an entry; to none of which no bit is set."""
    out, at = [], 0
    for batch, n in zip(batches, ns, strict=True):
        a, b = smaller[at : at + n], mixed[at : at + n]
        at += n
        if a.any() or b.any():
            out.append((batch, n, np.packbits(a).tobytes() + np.packbits(b).tobytes()))
    return pa.table({
        "batch": pa.array([x[0] for x in out], pa.int32()),
        "shard": pa.array([shard] * len(out), pa.int32()),
        "kind": pa.array([kind] * len(out), pa.int32()),
        "n": pa.array([x[1] for x in out], pa.int32()),
        "blob": pa.array([x[2] for x in out], pa.binary()),
    })


def _judge(kind: int, mail: pa.Table) -> pa.Table:
    """For each entry of each batch: has a smaller document the same; has its key other content as well."""
    batches, ns, key, content, doc = _opened(mail)
    smaller, mixed = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    order = np.argsort(key, kind="stable")  # merges the batches' sorted runs
    sorted_key = key[order]
    twin = np.zeros(len(key), dtype=bool)
    twin[1:] = sorted_key[1:] == sorted_key[:-1]
    twin[:-1] |= twin[1:]
    rows = order[twin]
    if len(rows):
        rows = rows[np.lexsort((doc[rows], content[rows], key[rows]))]
        k, c, d = key[rows], content[rows], doc[rows]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new = new_key | np.r_[True, c[1:] != c[:-1]]
        least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
        contents = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
        smaller[rows] = least < d
        mixed[rows] = (contents > 1) & (least == d)
    return _told(kind, mail["shard"][0].as_py(), batches, ns, smaller, mixed)


def _merged(mail: pa.Table) -> tuple[list[int], list[int], np.ndarray, Entries]:
    """Batches and sizes of the mail of a bundle, its documents, and the entries of all its batches as one batch's."""
    batches, ns, key, content, doc = _opened(mail)
    return batches, ns, doc, _entries(key, content, doc)


def _settled(kind: int, mail: pa.Table, answers: pa.Table, shards: int) -> pa.Table:
    """Answers to the batches of a bundle, from those that the bundle got as one batch."""
    batches, ns, doc, entries = _merged(mail)
    smaller, mixed = _answers(entries, answers, kind, shards)
    smaller = smaller[entries.of] | (entries.least[entries.of] < doc)
    return _told(kind, mail["shard"][0].as_py(), batches, ns, smaller, mixed[entries.of] & ~smaller)


def _answers(entries: Entries, table: pa.Table, kind: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    smaller, mixed = np.zeros(len(entries.key), dtype=bool), np.zeros(len(entries.key), dtype=bool)
    cuts = shard_cuts(entries.key, shards)
    for shard, k, n, blob in zip(*(table[c].to_pylist() for c in ("shard", "kind", "n", "blob")), strict=True):
        if k != kind:
            continue
        a, z = cuts[shard], cuts[shard + 1]
        if z - a != n:
            raise RuntimeError("a batch has changed between the stages")
        bits = np.frombuffer(blob, dtype=np.uint8)
        half = len(bits) // 2
        smaller[a:z] = np.unpackbits(bits[:half], count=n).astype(bool)
        mixed[a:z] = np.unpackbits(bits[half:], count=n).astype(bool)
    return smaller, mixed


class Edges(NamedTuple):
    """The windows that have to be looked at one by one."""

    part: np.ndarray
    start: np.ndarray
    doc: np.ndarray
    entries: Entries


def _verdicts(parts: list[Part], table: pa.Table, window: int, shards: int) -> tuple[np.ndarray, Edges]:
    """Whether each group is a repeat as a whole, and the windows of those that may be one in part."""
    entries = _group_entries(parts)
    smaller, mixed = _answers(entries, table, 0, shards)
    doc = _joined([p.doc for p in parts], np.int64)
    whole = smaller[entries.of] | (doc > entries.least[entries.of])
    partly = mixed[entries.of] & ~whole
    piece, start, docs, key, check, at = [], [], [], [], [], 0
    for i, p in enumerate(parts):
        rows = np.flatnonzero(partly[at : at + len(p.doc)])
        at += len(p.doc)
        count = p.groups.count[rows]
        first = np.repeat(p.groups.start[rows] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        piece.append(np.full(len(first), i))
        start.append(first)
        docs.append(np.repeat(p.doc[rows], count))
        key.append(p.spans(first, window))
        check.append(np.repeat(p.groups.anchor[rows] & _LOW32, count))
    windows = _entries(_joined(key, U64), _joined(check, U64), _joined(docs, np.int64))
    return whole, Edges(_joined(piece, np.int64), _joined(start, np.int64), _joined(docs, np.int64), windows)


def _kept_texts(part: Part, kept: np.ndarray, changed: np.ndarray, joined: bool) -> list[bytes]:
    """Each text without its removed words; each kept word keeps the separator byte that follows it.

    joined: all texts' words are joined by one space. Else a text from which nothing goes stays as it is.
    """
    words = part.words
    data = words.data
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, words.start[kept], 1)
    np.add.at(inside, words.end[kept], -1)
    take = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    after = words.end[kept]
    stop = words.offsets[1:][words.text_of[kept]]
    after = after[after < stop]
    take[after] = True
    if joined:
        data = np.where(SPACES[data], np.uint8(0x20), data)
    sizes = np.r_[0, np.cumsum(take)][words.offsets]
    packed = data[take].tobytes()
    out = []
    for i in range(part.rows):
        if not joined and not changed[i]:
            out.append(data[words.offsets[i] : words.offsets[i + 1]].tobytes())
        else:
            text = packed[sizes[i] : sizes[i + 1]]
            out.append(text[:-1] if text[-1:] in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r") else text)
    return out


def remove_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", keep: Sequence[str] = (), window: int = 13,
    levels: int = 2, joined: bool = False, mail_rows: int = MAIL_ROWS,
) -> DataFrame:
    """``docs`` without the words covered by a window of ``window`` words that a document of smaller id has too.

    docs   : any frame with an integer id and a text; other columns count only if named in ``keep``
    levels : rounds of pair naming; changes the work and never the result
    mail_rows : batches times shards from which mail goes in two steps, through bundles of batches; likewise
    joined : ``text`` holds the kept words joined by one space; else each keeps the separator after it, and a text
             that loses nothing stays as it is

    Returns id, ``text``, n_words long, n_removed long, removed (array of structs start, end: runs of removed words)
    and the columns of ``keep``, of which those named like the others are left out. Windows are judged on the input.
    A null text has no words and stays null. A document without an id loses nothing and takes nothing from others.
    Rows with one id are documents of their own, none of which is smaller than the other. A text with fewer than
    ``window`` words is kept. The result is the same for any number of batches and shards.
    """
    row = [c for c in keep if c.lower() not in (id.lower(), text.lower(), "n_words", "n_removed", "removed")]
    frame = docs.select(
        F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in row] or [F.lit(0).alias("none")]).alias("row"),
    )
    batches, shards = pieces(frame, 5), pieces(frame, 64)
    # Documents without an id meet no others, so they are not dealt.
    alone = frame.where("id IS NULL")
    frame = frame.where("id IS NOT NULL").withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int"))

    # In two steps, batches send to few wide shards, in which each bundle of batches sends on as one batch to the shards
    # that these consist of. So there are as many rows of mail as batches times the root of the shards, twice.
    wide, bundle = shards, 1
    if batches * shards > mail_rows:
        wide = bundle = max(2, math.isqrt(shards))
        shards = wide * -(-shards // wide)
    fine = shards // wide

    def judged(mail: DataFrame, kind: int) -> DataFrame:
        """Answers to batches, for mail to wide shards."""
        judge = lambda table: _judge(kind, table)
        if bundle == 1:
            return mail.groupBy("shard").applyInArrow(grouped(judge), ANSWER)
        mail = mail.withColumn("bundle", F.floor(F.col("batch") / bundle).cast("int"))

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            return _mail(key[0].as_py(), _merged(table)[3], shards)

        def settle(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            return _settled(kind, table, answers, shards) if table.num_rows else _NO_ANSWERS

        once = mail.groupBy("bundle", "shard")
        found = once.applyInArrow(grouped(merge), MAIL).groupBy("shard").applyInArrow(grouped(judge), ANSWER)
        found = found.withColumn("wide", F.floor(F.col("shard") / fine).cast("int"))
        return once.cogroup(found.groupBy("batch", "wide")).applyInArrow(grouped(settle), ANSWER)

    def reveal(key: tuple, table: pa.Table) -> pa.Table:
        return _mail(key[0].as_py(), _group_entries(_parts(table["id"], table["text"], window, levels)), wide)

    def reveal_edges(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not table.num_rows:
            return _mail(key[0].as_py(), _entries(*(np.zeros(0, dtype=t) for t in (U64, U64, np.int64))), wide)
        _, edges = _verdicts(_parts(table["id"], table["text"], window, levels), answers, window, wide)
        return _mail(key[0].as_py(), edges.entries, wide)

    kind = frame.schema["row"].dataType
    out_schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("row", kind),
    ])

    def cut(_: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = table["text"]
        parts = _parts(table["id"], texts, window, levels)
        whole, edges = _verdicts(parts, answers, window, wide)
        smaller, _ = _answers(edges.entries, answers, 1, wide)
        single = smaller[edges.entries.of] | (edges.doc > edges.entries.least[edges.entries.of])
        kept_texts, n_words, n_removed, runs, sizes, at = [], [], [], [], [], 0
        for i, p in enumerate(parts):
            cover = np.zeros(len(p.words) + 1, dtype=np.int64)
            rows = np.flatnonzero(whole[at : at + len(p.doc)])
            at += len(p.doc)
            np.add.at(cover, p.groups.start[rows], 1)
            np.add.at(cover, p.groups.start[rows] + p.groups.count[rows] + (window - 1), -1)
            hits = edges.start[(edges.part == i) & single]
            np.add.at(cover, hits, 1)
            np.add.at(cover, hits + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            first = p.words.first
            lost = np.r_[0, np.cumsum(gone)][first]
            lost = np.diff(lost)
            n_words.append(p.words.counts)
            n_removed.append(lost)
            edge = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)) != 0)
            begin = np.flatnonzero(gone & np.r_[True, ~gone[:-1] | (p.words.text_of[1:] != p.words.text_of[:-1])]) if len(gone) else edge
            stop = np.flatnonzero(gone & np.r_[~gone[1:] | (p.words.text_of[1:] != p.words.text_of[:-1]), True]) + 1 if len(gone) else edge
            owner = p.words.text_of[begin]
            runs.append(np.stack([begin - first[owner], stop - first[owner]], axis=1))
            sizes.append(np.bincount(owner, minlength=p.rows))
            kept_texts += _kept_texts(p, ~gone, lost > 0, joined)
        spans = _joined(runs, np.int64).reshape(-1, 2)
        missing = np.asarray(texts.is_null().combine_chunks().to_numpy(zero_copy_only=False))
        pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"])
        offsets = np.r_[0, np.cumsum(_joined(sizes, np.int64))].astype(np.int32)
        return pa.table({
            "id": table["id"],
            "text": pa.array(kept_texts, pa.binary(), mask=missing).cast(pa.string()),
            "n_words": pa.array(_joined(n_words, np.int64), pa.int64()),
            "n_removed": pa.array(_joined(n_removed, np.int64), pa.int64()),
            "removed": pa.ListArray.from_arrays(pa.array(offsets), pairs),
            "row": table["row"],
        })

    def cut_alone(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row, rows in slices(batch.column(1), 1 << 23):
                yield from cut((), pa.Table.from_batches([batch.slice(row, rows)]), _NO_ANSWERS).combine_chunks().to_batches()

    dealt = frame.groupBy("batch")
    groups = judged(dealt.applyInArrow(grouped(reveal), MAIL), 0)
    edges = dealt.cogroup(groups.groupBy("batch")).applyInArrow(grouped(reveal_edges), MAIL)
    windows = judged(edges, 1)
    out = dealt.cogroup(groups.unionAll(windows).groupBy("batch")).applyInArrow(grouped(cut), out_schema)
    out = out.unionAll(alone.mapInArrow(streaming(cut_alone), out_schema))
    return out.select(
        F.col("id").alias(id), F.col("text").alias(text), "n_words", "n_removed", "removed",
        *[F.col(f"row.`{c}`").alias(c) for c in row],
    )


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words of repeated windows removed from ``documents``; the digest columns of the kept words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(docs, joined=True)
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS p,
         unnest(list_transform(range(1, len(words) - 11), lambda i: array_to_string(words[i:i + 12], ' '))) AS h
  FROM w WHERE len(words) >= 13),
least AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM win JOIN least USING (h) WHERE d < doc_id),
long AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
rest AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept
  FROM long ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN rest USING (doc_id)
"""
