from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.llm import decontamination, jaccard_join, quality_rules
from tests.llm.conftest import texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measurements(docs):
    found = quality_rules.report(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == Counter((i, *measured(t)) for i, t in texts())
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_policy_and_ablation(docs, no_docs):
    led = quality_rules.ledger(docs)
    kept = quality_rules.apply_policy(docs, "base-1")
    assert kept.columns == docs.columns
    assert kept.count() == led.filter("fail_bits & 3 = 0").count()
    by_rule = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(led).collect()}
    bits = [r.fail_bits for r in led.collect()]
    for i, rule in enumerate(quality_rules.RULES):
        assert by_rule[rule.name] == (sum(b >> i & 1 for b in bits), sum(b == 1 << i for b in bits))
    assert quality_rules.report(no_docs).count() == 0


def test_policies_read_the_stored_ledger_alone(docs, no_docs, spark):
    folder = quality_rules.write_ledger(docs)
    led = quality_rules.read_ledger(spark, folder)
    assert "text" not in led.columns and led.count() == docs.count()
    for asked in (quality_rules.verdicts(led, "full-1"), quality_rules.ablation(led), quality_rules.policy_counts(led)):
        assert all(folder.split("/")[-1] in f for f in asked.inputFiles())
    kept = {r.policy: (r.n_kept, r.n_rejected) for r in quality_rules.policy_counts(led).collect()}
    for policy in quality_rules.POLICIES:
        n = quality_rules.apply_policy(docs, policy).count()
        assert kept[policy] == (n, docs.count() - n)
    assert quality_rules.policy_counts(quality_rules.read_ledger(spark, quality_rules.write_ledger(no_docs))).count() == 0


def test_another_rule_set_has_a_ledger_of_its_own(docs, spark, monkeypatch):
    folder = quality_rules.write_ledger(docs)
    monkeypatch.setattr(quality_rules, "RULES", (*quality_rules.RULES, quality_rules.Rule("no_lines", "n_lines = 0")))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        quality_rules.read_ledger(spark, folder)
    quality_rules.write_ledger(docs, folder)
    assert quality_rules.read_ledger(spark, folder).filter("fail_bits >= 512").count() > 0


def test_columns_of_the_tables_own(spark, docs):
    """Columns that bear names of the operators come through as they were."""
    clash = docs.select("doc_id", "text", *[F.lit(-99).alias(c) for c in ("_words", "_lines", "n_words", "fail_bits", "row", "key", "bad", "d", "t", "_d", "_t", "node", "start")])
    kept = quality_rules.apply_policy(clash)
    assert kept.columns == clash.columns
    assert {tuple(r)[2:] for r in kept.collect()} == {(-99,) * 13}
    assert kept.count() == quality_rules.apply_policy(docs).count()
    assert quality_rules.apply_policy(docs, "full-1").filter("doc_id = 12").count() == 1
    bench = spark.createDataFrame([("q1", "one two three", 5)], "item_id string, text string, window int")
    clean = decontamination.decontaminate(clash, bench)
    assert clean.columns == clash.columns and {tuple(r)[2:] for r in clean.collect()} == {(-99,) * 13}
    assert clean.count() == docs.count() - 2
    kept = jaccard_join.keep_first(clash)
    assert kept.columns == clash.columns and {tuple(r)[2:] for r in kept.collect()} == {(-99,) * 13}
    assert jaccard_join.report(clash).count() == docs.count()


def brute(doc_rows, item_rows):
    items = [(str(i or ""), ITEM_WORD.findall((t or "").translate(LOWER))) for i, t in item_rows]
    out = []
    for i, t in doc_rows:
        w, hit, ids = ITEM_WORD.findall((t or "").translate(LOWER)), set(), set()
        for name, x in items:
            n = min(13, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add(name)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("bounds", [None, 0])
def test_contamination(spark, docs, no_docs, monkeypatch, bounds):
    """With what is broadcast, and with all joins shuffled."""
    if bounds is not None:
        for name in ("BROADCAST_SHINGLES", "BROADCAST_WINDOWS", "BROADCAST_DOCS"):
            monkeypatch.setattr(decontamination, name, bounds)
    rows = texts()
    long = ITEM_WORD.findall(rows[0][1])
    items = [("q1", " ".join(long[5:40])), ("q2", " ".join(long[20:30]).upper()), ("q3", "one two"), ("q4", None), ("q5", "!!"), (None, "b c d"), ("q1", " ".join(long[70:90])), ("q6", " ".join(long[5:40])), ("q7", "never seen words at all in any of these documents here today yes")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id string, text string, n_words int")
    found = decontamination.report(docs, bench)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == brute(rows, items)
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == found.filter("not contaminated").count()
    assert decontamination.report(no_docs, bench).count() == 0
    assert decontamination.report(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_very_long_text(spark):
    """A text full of item words takes time in proportion to its length."""
    rng = random.Random(1)
    item = words(rng, 40)
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    took = []
    for n in (500, 8000):
        text = " ".join([item] * n)
        began = time.time()
        row = decontamination.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
        took.append(time.time() - began)
        assert (row.n_words, row.n_hit, row.n_items) == (40 * n, 40 * n, 1)
    assert took[1] < 5 * took[0] + 8
