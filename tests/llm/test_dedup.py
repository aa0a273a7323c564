"""Operators 1 and 2 against brute force on texts with ties, copies, nulls, runs and clashing names."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from spoor.llm import near_dedup, recompression, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.25:
            t = WORD.findall(rng.choice(texts) or "")
            for _ in range(rng.randrange(4)):
                if t:
                    t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        elif texts and kind < 0.45:
            t = WORD.findall(rng.choice(texts) or "")
            a = rng.randrange(len(t) + 1)
            texts.append(" ".join([*rng.choices(words, k=rng.randrange(30)), *t[a : a + rng.randrange(40)], *rng.choices(words, k=9)]))
        elif kind < 0.5:
            texts.append(rng.choice([None, "", " \n", "one", "a a a a a " * 12, "a " * 40]))
        else:
            texts.append(rng.choice([" ", "\n", "\t "]).join(rng.choices(words, k=rng.randrange(3, 90))))
    return [(i if i % 17 else None if i == 17 else i, t) for i, t in enumerate(texts)]


def repeats(rows, window=13):
    least = {}
    lists = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in lists:
        for p in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[p : p + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in lists:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [0.002, 0.0005])
def test_mail_in_two_steps_changes_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "pieces", lambda df, each_mb: int(each_mb / size / 400))
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.remove_repeats(docs, joined=True, mail_rows=0).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in found), key=repr) == repeats(rows)


@pytest.mark.parametrize(("seed", "levels"), [(1, 2), (2, 3)])
def test_repeats_are_those_of_brute_force(spark, seed, levels):
    rows = [*corpus(seed), (5, "again " * 20), (5, "again " * 20)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, batch string, n_words int")
    found = substring_dedup.remove_repeats(docs, levels=levels, joined=True, keep=["batch", "n_words"]).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text or "") for r in found), key=repr) == repeats(rows)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed and r.batch == "x" for r in found)


def test_a_text_that_loses_nothing_stays_as_it_is(spark):
    docs = spark.createDataFrame([(1, " a \n b "), (2, None)], "doc_id long, text string")
    assert {r.text for r in substring_dedup.remove_repeats(docs).collect()} == {" a \n b ", None}
    assert substring_dedup.remove_repeats(docs.where("false")).count() == 0


def test_symbols_are_found_wherever_the_words_they_depend_on_stand():
    rng = np.random.default_rng(3)
    inner = rng.integers(0, 9, 60).astype(np.uint64)
    names = [np.r_[rng.integers(0, 9, k).astype(np.uint64), inner, rng.integers(0, 9, k).astype(np.uint64)] for k in (3, 11)]
    found = []
    for k, n in zip((3, 11), names, strict=True):
        s = recompression.name_runs(n, np.zeros(len(n), dtype=np.int64))
        for level in range(4):
            s = recompression.name_pairs(s, level)
        assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()
        inside = (s.low >= k) & (s.high < k + len(inner))
        found.append({(int(a), int(b - k)) for a, b in zip(s.name[inside], s.start[inside], strict=True)})
    assert found[0] == found[1] and found[0]


def brute(rows, size, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = doc if least[root(i)] is None else min(doc, least[root(i)])
    return sorted(((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("block", [256, 4])
def test_components_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [*corpus(4, 150), (3, "again and again and on"), (3, "again and again and on")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node int")
    found = near_dedup.near_duplicates(docs, shingle=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id if r.component_id is not None else True) for r in found)


def test_one_document_of_each_component_stays(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(4, long), (2, long + " y"), (2, long + " y"), (9, "else here"), (None, "else here"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup.deduplicate(docs).collect()) == [2, 7, 9]
    assert near_dedup.near_duplicates(docs.where("false")).count() == 0


def test_pruning_keeps_what_may_reach_the_threshold():
    assert [near_dedup.least_matches(n, 0.8, 1e-6) for n in (32, 128)] == [13, 79] or near_dedup.least_matches(128, 0.8, 1e-6) < 100
    sets = [np.arange(5), np.arange(3, 9), np.arange(0), np.arange(70000)]
    assert near_dedup.intersections(sets, np.array([0, 0, 1, 2]), np.array([1, 3, 3, 3])).tolist() == [2, 5, 6, 0]
