"""BPE, vector codes and periodic runs against the library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skein.llm import bpe, periodic, vector_codes
from skein.llm.tokens import tokenizer_path
from tests.llm.conftest import texts

sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# ---- BPE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_encoding_and_decoding_equal_the_library(library):
    rng = random.Random(1)
    alphabet = [*"abcdefghij  \n\t'sdlrevm01#$.-=_<|>", "é", "É", "ß", "İ", "Σ", "ς", "́", "　", " ", "漢", "字", "😀", "\x0b", "\x1c", "\x85", "\0", "½", "१", "ﬁ", "각", "ᄀ", "ᅡ", "<|endoftext|>", "<|startoftext|>"]
    said = ["", "a", " ", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "The Quick brown's don't we'll"]
    said += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    said += ["x" * 3000, "ab" * 2000, "=" * 700 + " hello", "".join(rng.choice("etaoin") for _ in range(5000)), "é" * 900]
    e = bpe.tree_encoder(tokenizer_path("word_bpe_49k.json"))
    ids, starts, counts = e.encode(pa.array(said))
    each = [ids[s : s + n].tolist() for s, n in zip(starts, counts, strict=True)]
    assert each == [library.encode(t, add_special_tokens=False).ids for t in said]
    flat = np.concatenate([np.array(x, np.uint32) for x in each])
    assert e.decode(flat, counts).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in each]


def test_trees_of_many_words_and_of_one_agree():
    m = bpe.merges(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 40))).encode() for _ in range(500)]
    sizes = np.array([len(w) for w in words])
    symbols = m.by_byte[0][np.frombuffer(b"".join(words), np.uint8)]
    last = np.cumsum(sizes) - 1
    symbols[last] = m.by_byte[1][np.frombuffer(b"".join(words), np.uint8)[last]]
    ids, counts = m.merge(symbols, sizes)
    alone = [m.merge_one(s.tolist()) if len(s) > 1 else s.tolist() for s in np.split(symbols, last[:-1] + 1)]
    assert np.split(ids, np.cumsum(counts)[:-1])[7].tolist() == alone[7] and ids.tolist() == [i for a in alone for i in a]


def test_bpe_rows(spark, docs, no_docs, library):
    got = Counter(map(tuple, bpe.report(docs).collect()))
    want = Counter()
    for i, t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    assert bpe.report(no_docs).count() == 0
    both = bpe.decode(bpe.encode(docs, ids="coded"), "coded", "back", skip_special=True)
    assert both.columns == [*docs.columns, "coded", "back"] and both.filter("doc_id = 16").first().back == "one</w> two</w>"
    with pytest.raises(ValueError):
        bpe.encode(docs, ids="Lang")
    odd = spark.createDataFrame([(np.array([0, 99_999_999], "<u4").tobytes(),), (None,)], "ids binary")
    assert [r.decoded for r in bpe.decode(odd).collect()] == ["!", None]


# ---- vector codes


def codes_by_brute_force(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def nearest(x, book):
        far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return far.index(min(far)), min(far)

    def assign():
        return [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found, strict=True) if f[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = assign()
    errors = [sum(d for _, d in f) for f in found]
    by_label = Counter()
    for (*_, label), error in zip(kept, errors, strict=True):
        by_label[label] += error
    digest = sha(",".join(str(c) for b in books for e in b for c in e))
    return Counter((i, "".join(f"{e:02x}" for e, _ in f), error, by_label[label], digest) for (i, _, label), f, error in zip(kept, found, errors, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, vector string"


@pytest.mark.parametrize(("width", "n", "spread"), [(32, 150, 0.3), (16, 40, 0.02), (48, 80, 5e5), (16, 120, 1e-3)])
def test_codes_equal_brute_force(spark, width, n, spread):
    rng = random.Random(width)
    vector = lambda: [float(np.float32(rng.gauss(0, spread))) for _ in range(width)]
    rows = [(i, vector(), rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [None] * width, 1), (n + 3, [float("nan")] * width, 0), (n + 4, [float("-inf")] * width, 0), (None, vector(), 1), (3, vector(), None)]
    rows += [(n + 10 + i, rows[5][1], 2) for i in range(60)] + [rows[7]] * 2
    got = vector_codes.report(spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS))
    assert Counter(map(tuple, got.collect())) == codes_by_brute_force(rows)


def test_codes_of_odd_tables(spark):
    df = lambda rows: spark.createDataFrame([(*r, "", "", "") for r in rows], VECTORS)
    assert vector_codes.report(df([])).count() == 0 and vector_codes.report(df([(1, None, 1)])).count() == 0
    assert [r.code for r in vector_codes.report(df([(1, [], 1)])).collect()] == ["00" * 16]
    for rows in ([(1, [0.5] * 8, 1)], [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)]):
        with pytest.raises(ValueError):
            vector_codes.report(df(rows))


def test_exponion_skips_entries_and_keeps_ties():
    rng = np.random.default_rng(4)
    entries = rng.integers(-40, 40, (16, 64, 2))
    entries[:, 9] = entries[:, 3]  # equal entries: the lower index
    books = vector_codes.Codebooks(entries)
    vectors = rng.integers(-40, 40, (500, 16, 2))
    all_far = ((vectors[:, :, None] - entries[None]) ** 2).sum(3)
    found, far, looked = books.assign(vectors, all_far.argmin(2))
    assert (found == all_far.argmin(2)).all() and (far == all_far.min(2)).all() and looked < 500 * 16 * 20
    found, far, _ = books.assign(vectors, rng.integers(0, 64, (500, 16)))
    assert (found == all_far.argmin(2)).all() and (far == all_far.min(2)).all()


def test_a_label_of_a_third_of_all_rows_is_not_shuffled_whole(spark):
    coded = spark.range(9000).selectExpr("id as vec_id", "if(id % 3 = 0, null, cast(id as int)) as label", "id as error")
    got = {r.vec_id: r.label_error for r in vector_codes.with_label_error(coded).collect()}
    nulls = sum(range(0, 9000, 3))
    assert got == {i: nulls if i % 3 == 0 else i for i in range(9000)}


# ---- periodic runs


def runs_by_brute_force(w, least=6, times=4):
    found = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - start + q
            if i > start and n >= max(least, times * q) and not any(q % p == 0 and s <= start and s + k >= start + n for s, k, p in found):
                found.append((start, n, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeated(w, a, p):
    return [*w[:a], *(w[a + (i - a) % p] for i in range(a, len(w)))]


def test_runs_equal_brute_force():
    rng = random.Random(5)
    said = []
    for _ in range(1500):
        w = [rng.choice("abcdefghijklmnopqrst"[: rng.choice([1, 2, 3, 20])]) for _ in range(rng.randrange(70))]
        if w and rng.random() < 0.6:
            a = rng.randrange(len(w))
            w = repeated(w, a, 1 + (len(w) - a) // (3 + rng.randrange(8)))
        said.append(w)
    said += [None, [], ["x"] * 3000, ["a", "b"] * 1500, [rng.choice("ab") for _ in range(1500)], (["a"] * 50 + ["b"]) * 30]
    lists = pa.array(said, pa.list_(pa.string()))
    runs, left = periodic._found(lists, 6, 4)
    for w, r, t in zip(said, runs.to_pylist(), left.to_pylist(), strict=True):
        want = runs_by_brute_force(w or [])
        assert [(x["start"], x["length"], x["period"]) for x in r] == want and t == collapsed(w or [], want)


def test_wrong_hashes_decide_nothing(monkeypatch):
    monkeypatch.setattr(periodic, "PRIME", 3)
    monkeypatch.setattr(periodic, "_times", lambda a, b: (np.asarray(a, np.uint64) * (np.asarray(b, np.uint64) % np.uint64(3))) % np.uint64(3))
    monkeypatch.setattr(periodic, "_powers", lambda k: np.ones(1 << k, np.uint64))
    rng = random.Random(6)
    for _ in range(200):
        w = repeated([rng.choice("ab") for _ in range(60)], rng.randrange(20), rng.randrange(1, 14))
        seq = periodic.Sequence(np.array([0, *(1 + "ab".index(c) for c in w), 0]))
        assert [(s - 1, n, q) for s, n, q in seq.runs(6, 4)] == runs_by_brute_force(w)


def test_periodic_rows(docs, no_docs):
    want = Counter()
    for i, t in texts():
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if x]
        h = None if i is None else zlib.crc32(str(i).encode())
        if h is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            w = repeated(w, a, 1 + (len(w) - a) // (3 + h // 10 % 8))
        runs = runs_by_brute_force(w) if len(w) < 5000 else []
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[(i, len(runs), *longest, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))] += 1
    assert Counter(map(tuple, periodic.report(docs).collect())) == want
    assert sum(r[1] > 0 for r in want) > 2
    assert periodic.report(no_docs).count() == 0
    named = docs.selectExpr("doc_id", "split(text, ' ') as words", "n_words as runs")
    with pytest.raises(ValueError):
        periodic.find(named)
    assert periodic.find(named, runs="found").columns == ["doc_id", "runs", "found", "collapsed"]
