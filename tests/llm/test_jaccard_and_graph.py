from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import graph, jaccard_join
from tests.llm.conftest import texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def grouped(rows):
    """Sets, and the root of each row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                root[find(a)] = find(b)
    return sets, [find(k) for k in range(len(rows))]


def brute(rows):
    sets, root = grouped(rows)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(i, least.get(root[k], i))
    return Counter((i, len(s), least.get(root[k]) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.report(df).collect())


def test_awkward_documents(docs, no_docs):
    assert found(docs) == brute(texts())
    assert jaccard_join.report(no_docs).count() == 0


@pytest.mark.parametrize("edits, long, sets", [(2, 200, 256), (6, 200, 256), (5, 10, 256), (6, 6, 8)])
def test_group_of_near_copies(spark, monkeypatch, edits, long, sets):
    """Copies that mostly link through a few others, beside documents that share one passage; with lists in blocks too."""
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", sets)
    rng = random.Random(edits)
    base, shared = words(rng, 150).split(), words(rng, 40)
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"{words(rng, rng.randint(20, 90))} {shared} {words(rng, 30)}") for i in range(60)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_of_each_group_stays(docs):
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    sets, root = grouped(texts())
    assert sum(bool(shingle_set(r.text)) for r in kept.collect()) == len({r for s, r in zip(sets, root, strict=True) if s})


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[150] == got[200] == 100
    for a, b in links:
        assert a == b or got[a] == got[b] <= min(a, b)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_word_of_any_length_is_one_word(spark):
    big = 1 << 18
    for size in (big - 1, big, big + 1, 300_000, 600_000, 2 * big):
        for text in ("x" * size, "a b c d " + "x" * size + " e f", "x" * size + " " + "x" * size, " " * 7 + "y" * size + "\n", "a b " + "x" * (size - 4) + " c d e f"):
            words = text.split()
            hashes = jaccard_join._word_hashes(np.frombuffer(text.encode(), np.uint8))
            assert len(hashes) == len(words)
            assert [h == hashes[0] for h in hashes] == [w == words[0] for w in words]
            alone = [jaccard_join._word_hashes(np.frombuffer(w.encode(), np.uint8))[0] for w in words]
            assert alone == hashes.tolist()
    other = jaccard_join._word_hashes(np.frombuffer(("x" * 299_999 + "y").encode(), np.uint8))
    assert other[0] != jaccard_join._word_hashes(np.frombuffer(b"x" * 300_000, np.uint8))[0]
    df = spark.createDataFrame([(1, "a b c d " + "x" * 300_000 + " e f"), (2, "A b c d " + "X" * 300_000 + " e f"), (3, "q " * 4 + "x" * 600_000)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.report(df).select("doc_id", "n_shingles", "component_id").collect())) == [(1, 3, 1), (2, 3, 1), (3, 1, 3)]
