"""The pipeline's rows against the same stages by brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
from skein.llm import secret_scan
from tests.llm.conftest import DOC, texts
from tests.llm.test_jaccard_and_graph import grouped
from tests.llm.test_rules_and_contamination import brute as contaminated
from tests.llm.test_rules_and_contamination import measured
from tests.llm.test_text_operators import base, ids_of


def keeps(text):
    n, chars, symbols, dup, repeated = measured(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    all_chars, once = sum(map(len, lines)), sum(map(len, set(lines)))
    plain = 2 * n <= chars <= 15 * n and 10 * symbols <= 4 * n and 2 * dup <= len(lines) and 5 * sum(map(str.isalpha, text or "")) >= 3 * chars
    marks = 10 * sum(bool(re.match(r"[ \t\r\x0b\x0c]*[-*•]", x)) for x in lines) <= 9 * len(lines) and 10 * sum(bool(re.search(r"(\.\.\.|…)[ \t\r\x0b\x0c]*$", x)) for x in lines) <= 3 * len(lines)
    return n >= 10 and 100 * repeated <= 20 * n and plain and marks and 10 * (all_chars - once) <= 3 * all_chars


def test_pipeline(spark, tmp_path):
    rows = texts()
    rows += [(200, f"{rows[0][1].upper()} token = 'abcdef0123456789abcdef' end of it"), (201, " ".join(f"word{k}" for k in range(60)) + " password: abcdefghijklmnop.")]
    items = [("q", " ".join(rows[-1][1].split()[:3] * 5)), ("r", " ".join(texts()[25][1].split()[:20]) or "none")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "x", "x") for i, t in rows], DOC).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(i, t) for i, t in rows if keeps(t)]
    sets, root = grouped(kept)
    first = {}
    for k, (i, t) in enumerate(kept):
        order = (i is None, i or 0)
        if root[k] not in first or order < first[root[k]][0]:
            first[root[k]] = (order, i, t)
    kept = [(i, t) for _, i, t in first.values()]
    bad = {r[0] for r in contaminated(kept, items) if r[5]}
    kept = [(i, secret_scan.masked(t, base(t))) for i, t in kept if i not in bad]
    want = Counter()
    for i, t in kept:
        ids = ids_of(t, "byte_bpe_50k.json")
        for s in range(0, len(ids), 2048):
            want[(i, s, zlib.crc32(ids[s : s + 2048].tobytes()), len(ids))] += 1
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in found.collect()) == want
    assert "[secret]" in dict(kept)[201]


def test_pipeline_of_nothing(spark, tmp_path):
    """Tables without rows, and with nulls alone."""
    for name, rows in (("none", []), ("nulls", [(None,) * 8] * 3)):
        spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(None, None)] if rows else [], "item_id string, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
    docs = spark.createDataFrame([(None,) * 8] * 3, DOC)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, str(tmp_path / "nulls")).columns == docs.columns
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == 3
