"""License scans with a generalised suffix automaton of license templates.

The automaton holds every run of words of every template. A text streams through it, which gives for each word the
longest run ending there that stands in a template (the matching statistics). Maximal long matches are chained, in
the order of both text and template, into spans that cover a share of a template.

A template may hold only a shorter run that ends at the same place as the longest one; suffix links lead to those.

Most words of a text stand in no template next to the word before them; those places are found for a whole batch at
once, and the automaton runs only over the stretches between them, where its state is known to be the root. A word that
is a phrase or a template by itself is a stretch of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spoor.llm.license_texts import templates
from spoor.llm.tokens import NON_ALNUM, Words, slices, words_of
from spoor.llm.workers import streaming

#: Short phrases and their labels; each place where one stands is reported.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License texts and notices, by label.
TEMPLATES = templates()


class Span(NamedTuple):
    """Words ``start : end`` of a text that follow a template; covered: the share of its words that are matched."""

    label: str
    start: int
    end: int
    covered: float


class Automaton:
    """Generalised suffix automaton over word hashes. Templates first, then phrases, are told apart by number."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        texts = [(label, t) for label, many in templates.items() for t in many]
        words = words_of(pa.array([t for _, t in texts] + list(phrases)), NON_ALNUM, lower=True)
        hashes = words.hashes()
        self.words = np.unique(hashes)
        ids = np.searchsorted(self.words, hashes)
        runs = [ids[a:z].tolist() for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(r) for r in runs[: len(texts)]]
        pairs = {a * len(self.words) + b for r in runs for a, b in zip(r, r[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last_of: list[tuple[int, tuple[int, int]]] = []
        for number, run in enumerate(runs):
            last = 0
            for at, word in enumerate(run):
                last = self._extend(last, word)
                if number < len(texts):
                    last_of.append((last, (number, at + 1)))
        self._place(last_of)
        self.single = np.array(sorted({r[0] for r in runs if len(r) == 1}), dtype=np.int64)
        self.phrases = [(label, len(run)) for label, run in zip(phrases.values(), runs[len(texts) :], strict=True)]
        own: dict[int, list[int]] = defaultdict(list)
        for number, run in enumerate(runs[len(texts) :]):
            state = 0
            for word in run:
                state = self.next[state][word]
            own[state].append(number)
        self.phrases_at: list[list[int]] = [[] for _ in self.link]
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.phrases_at[state] = own[state] + self.phrases_at[self.link[state]]

    def _place(self, last_of: list[tuple[int, tuple[int, int]]]) -> None:
        """Keeps where in templates the runs of each state end, each place once: a state's are those of the states that
        link to it, so in the order of a walk through the links they are one stretch of a list."""
        below: list[list[int]] = [[] for _ in self.link]
        for state in range(1, len(self.link)):
            below[self.link[state]].append(state)
        own: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for state, end in last_of:
            own[state].append(end)
        self.places: list[tuple[int, int]] = []
        self.first, self.stop = [0] * len(self.link), [0] * len(self.link)
        walk = [(0, False)]
        while walk:
            state, done = walk.pop()
            if done:
                self.stop[state] = len(self.places)
                continue
            self.first[state] = len(self.places)
            self.places += own.get(state, ())
            walk.append((state, True))
            walk += [(s, False) for s in below[state]]

    def ends(self, state: int) -> list[tuple[int, int]]:
        """(template, words) where a state's runs end."""
        return self.places[self.first[state] : self.stop[state]]

    def _copy(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self._split(last, word, known)
        state = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[state] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return state

    def _split(self, at: int, word: int, to: int) -> int:
        twin = self._copy(to, self.length[at] + 1)
        self.link[to] = twin
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def statistics(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """For each word of a run of word numbers: the state and the length of the longest match that ends there."""
        state = length = 0
        for word in run:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length

    def stretches(self, words: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, word numbers) of the maximal stretches in which each two neighbours stand in a template.

        A phrase or template of one word is a stretch by itself.
        """
        if not len(words):
            return
        hashes = words.hashes()
        number = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        number[self.words[number] != hashes] = -1
        text = words.text_of
        pair = (number[:-1] >= 0) & (number[1:] >= 0) & (text[1:] == text[:-1])
        at = np.flatnonzero(pair)
        code = number[at] * len(self.words) + number[at + 1]
        # Whether a word is joined to the one before it; a text's edge breaks the pairs by itself.
        joined = np.zeros(len(number) + 1, dtype=bool)
        if len(self.pairs):
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            joined[at[self.pairs[place] == code] + 1] = True
        inside = joined[:-1] | joined[1:]
        if len(self.single):
            inside |= np.isin(number, self.single)
        for first, last in zip(np.flatnonzero(inside & ~joined[:-1]), np.flatnonzero(inside & ~joined[1:]), strict=True):
            yield int(text[first]), int(first - words.first[text[first]]), number[first : last + 1].tolist()

    def matches(self, found: list[tuple[int, int]], least: int, whole: int = 0) -> list[tuple[int, int, int, int]]:
        """(template, text start, template start, words) of the longest matches of a stretch, in the order of their ends.

        found: the matching statistics. A match has ``least`` words or is a whole template, as it must be of those of up
        to ``whole`` words; it cannot be made longer, and lies in no longer match of the same template.
        """
        ending: list[dict[tuple[int, int], int]] = []
        enough = [n if n <= whole else min(least, n) for n in self.sizes]
        shortest = min(enough, default=least)
        for state, length in found:
            here: dict[tuple[int, int], int] = {}
            while state > 0 and length >= shortest:
                for template, end in self.ends(state):
                    if length >= enough[template]:
                        here.setdefault((template, end), length)
                state = self.link[state]
                length = self.length[state]
            ending.append(here)
        out: list[tuple[int, int, int, int]] = []
        begun: dict[int, int] = {}
        # From the end, so that a match that holds another comes before it.
        for at in range(len(ending) - 1, -1, -1):
            goes_on = ending[at + 1] if at + 1 < len(ending) else {}
            kept = [(template, end, n) for (template, end), n in ending[at].items() if (template, end + 1) not in goes_on]
            longest: dict[int, int] = {}
            for template, _, n in kept:
                longest[template] = max(n, longest.get(template, 0))
            here = [(t, at + 1 - n, end - n, n) for t, end, n in kept if n == longest[t] and at + 1 - n < begun.get(t, len(ending))]
            for template, start, _, _ in here:
                begun[template] = start
            out += sorted(here, key=lambda m: (m[0], m[2]), reverse=True)
        return out[::-1]

    def spans(self, matches: list[tuple[int, int, int, int]], gap: int) -> list[Span]:
        """Chains of (template, text start, template start, words) into spans, for matches in the order of the text.

        A chain goes on with a match after its end in both, at most ``gap`` words on; overlaps count once.
        """
        out: list[Span] = []
        open_: dict[int, tuple[int, int, int, int]] = {}

        def close(template: int) -> None:
            start, end, _, got = open_.pop(template)
            out.append(Span(self.labels[template], start, end, got / self.sizes[template]))

        for template, start, from_, words in matches:
            if template in open_:
                begin, end, upto, got = open_[template]
                skip = max(0, end - start, upto - from_)
                if skip < words and start - end <= gap and from_ - upto <= gap and start >= begin:
                    open_[template] = (begin, max(end, start + words), from_ + words, got + words - skip)
                    continue
                if words <= got and start < end:
                    continue
                close(template)
            open_[template] = (start, start + words, from_ + words, words)
        for template in list(open_):
            close(template)
        return out


def own_spans(spans: list[Span], enough: float) -> list[Span]:
    """Spans that cover enough of their templates, in order, but for those within one that covers more of its own: licenses of one
    family share most of their words."""
    some = sorted((s for s in spans if s.covered >= enough), key=lambda s: s[1:])
    best: list[Span] = []
    for s in sorted(some, key=lambda s: (-s.covered, s.start, -s.end)):
        if not any(t.covered > s.covered and t.start <= s.start and s.end <= t.end for t in best):
            best.append(s)
    return [s for s in some if s in best]


def scan(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None, least: int = 5, whole: int = 10, gap: int = 8,
    enough: float = 0.6,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, places (array of structs label, start: each phrase in the
    text), spans (array of structs label, start, end, covered), score (largest share covered, 0 to 1).

    Words are runs of ASCII letters, digits and other characters than ASCII, A-Z lower-cased; the first is 0.
    least  : words of the shortest match that is chained, or fewer if the template has no more
    whole  : templates of up to so many words, as notices are, match as a whole or not at all
    gap    : words that a chain may skip in text and template
    enough : the share of a template that a reported span covers; one within another that covers more of its own is not reported

    A null text counts as empty and has neither. Texts are streamed whole; working memory is that of a few MB of
    text, or of one longer text. Rows with equal ids are apart. Other columns do not matter.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    frame = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())])
    span = T.StructType([*place.fields, T.StructField("end", T.LongType()), T.StructField("covered", T.DoubleType())])
    schema = T.StructType([
        frame.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)),
        T.StructField("spans", T.ArrayType(span)), T.StructField("score", T.DoubleType()),
    ])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, phrases)
        for batch in stream:
            for row, rows in slices(batch.column(1)):
                words = words_of(batch.column(1).slice(row, rows), NON_ALNUM, lower=True)
                places: list[list[dict]] = [[] for _ in range(rows)]
                matches: list[list[tuple]] = [[] for _ in range(rows)]
                for of, first, run in automaton.stretches(words):
                    found = list(automaton.statistics(run))
                    for at, (state, length) in enumerate(found):
                        for number in automaton.phrases_at[state]:
                            label, size = automaton.phrases[number]
                            if size <= length:
                                places[of].append({"label": label, "start": first + at + 1 - size})
                    matches[of] += [(t, first + start, from_, n) for t, start, from_, n in automaton.matches(found, least, whole)]
                spans = [automaton.spans(m, gap) for m in matches]
                score = [max((s.covered for s in many), default=0.0) for many in spans]
                told = [[s._asdict() for s in own_spans(many, enough)] for many in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, rows), pa.array(words.counts, pa.int64()),
                        pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                        pa.array(told, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())]))),
                        pa.array(score, pa.float64()),
                    ],
                    [f.name for f in schema],
                )

    return frame.mapInArrow(streaming(work), schema).withColumnRenamed("id", id)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """License phrases and notices in every text of ``documents``."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts = F.transform("places", lambda x: x["start"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"])))
    both = F.array_sort(F.array_union(base, F.transform("spans", lambda x: x["label"])))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score",
    )
