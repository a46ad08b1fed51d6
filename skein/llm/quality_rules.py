"""Quality rules as a ledger of failure bits (DataFrame functions alone).

Every rule is evaluated once; its failure is one bit of ``fail_bits`` beside the
measurements it used.  ``write_ledger`` stores both under the version of the rule set.  A policy
is a versioned mask over the bits, so another policy (``verdicts``, ``policy_counts``) or what a
rule costs (``ablation``) is read from the stored ledger and never from the texts.
``apply_policy`` filters a table in the pass that measures it, where no ledger is wanted.

Defined cases: a null text has no words and fails ``few_words``; an empty table gives an
empty ledger; repeated rows are judged one by one; a very long text is judged whole.  In
``measure`` and ``ledger`` further columns pass through unless they bear the name of a
measurement, which then wins; ``apply_policy`` and ``report`` never mix theirs with a table's.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import SPACES, let, new_path, split_words

#: Words of a window in which repetition is looked for.
WINDOW = 5
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements, true where a document fails."""

    name: str
    fails: str


#: A rule's place is its bit; rules are only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 4 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("few_letters", "5 * n_letters < 3 * word_chars"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("repeated_line_chars", "10 * dup_line_chars > 3 * line_chars"),
)

#: Versioned policies: names of the rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": ("few_words", "repeated_words", "word_length", "symbols", "repeated_lines"),
    "full-2": tuple(r.name for r in RULES[:9]),
}
POLICY = "full-2"
BASE = POLICIES["base-1"]


def mask(names: tuple[str, ...] | list[str]) -> int:
    """The bits of the named rules."""
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[n] for n in names)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash (one for each start) comes twice or more."""

    def covered(h: Column) -> Column:
        def neighbours(s: Column) -> Column:
            same = lambda j: F.coalesce(F.get(s, j)["h"] == F.get(s, j + 1)["h"], F.lit(False))
            return F.transform(s, lambda e, j: F.when(same(j) | same(j - 1), e["at"]))

        starts = F.array_sort(F.array_compact(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))), neighbours)))
        steps = let(starts, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))


def _fresh(name: str, taken: list[str]) -> str:
    """``name`` with as many underscores before it as no column of ``taken`` has."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements (long): words, characters, symbols, letters, lines of several kinds, repeated words."""
    body = F.coalesce(F.col(text), F.lit(""))

    def repeats(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.struct(F.size(w).alias("n_words"), F.when(F.size(w) <= WINDOW, 0).otherwise(_covered(windows)).alias("n_repeat_words"))

    def lines(x: Column) -> Column:
        chars = lambda a: F.length(F.array_join(a, ""))
        own = let(F.array_distinct(x), lambda d: F.struct((F.size(x) - F.size(d)).alias("n_dup_lines"), (chars(x) - chars(d)).alias("dup_line_chars")))
        return F.struct(
            F.size(x).alias("n_lines"),
            chars(x).alias("line_chars"),
            own.alias("own"),
            F.size(F.filter(x, lambda v: v.rlike(f"^[{SPACES}]*[-*•]"))).alias("n_bullet_lines"),
            F.size(F.filter(x, lambda v: v.rlike(rf"(\.\.\.|…)[{SPACES}]*$"))).alias("n_ellipsis_lines"),
        )

    w, x = _fresh("_words", docs.columns), _fresh("_lines", docs.columns)
    of_words = let(split_words(body, SPACES), repeats)
    of_lines = let(F.filter(F.split(body, "\n"), lambda v: v.rlike(f"[^{SPACES}]")), lines)
    blank = F.length(F.regexp_replace(body, f"[^{SPACES}]+", ""))
    left = lambda kept: F.length(F.regexp_replace(body, f"[^{kept}]+", ""))
    measured = {
        "n_words": F.col(f"{w}.n_words"),
        "word_chars": F.length(body) - blank,
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, f"[{SYMBOLS}]+", "")),
        "n_letters": left(r"\p{L}"),
        "n_lines": F.col(f"{x}.n_lines"),
        "line_chars": F.col(f"{x}.line_chars"),
        "n_dup_lines": F.col(f"{x}.own.n_dup_lines"),
        "dup_line_chars": F.col(f"{x}.own.dup_line_chars"),
        "n_bullet_lines": F.col(f"{x}.n_bullet_lines"),
        "n_ellipsis_lines": F.col(f"{x}.n_ellipsis_lines"),
        "n_repeat_words": F.col(f"{w}.n_repeat_words"),
    }
    found = docs.withColumns({w: of_words, x: of_lines})
    return found.withColumns({k: v.cast("long") for k, v in measured.items()}).drop(w, x)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``measure()`` and ``fail_bits`` (long): bit i is set where ``RULES[i]`` fails."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    return measure(docs, text).withColumn("fail_bits", sum(bits[1:], bits[0]).cast("long"))


def version() -> str:
    """Of the rule set: how many rules, and a digest of their names and conditions."""
    return f"{len(RULES)}-{hashlib.sha256(repr([(r.name, r.fails) for r in RULES]).encode()).hexdigest()[:12]}"


def write_ledger(docs: DataFrame, folder: str | None = None) -> str:
    """Stores doc_id, measurements and failure bits of ``docs`` in ``folder``, under the rule set's version; gives the folder."""
    folder = folder or new_path(docs.sparkSession, "quality-ledger")
    ledger(docs.select("doc_id", "text")).drop("text").write.mode("overwrite").parquet(f"{folder}/rules={version()}")
    return folder


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The stored ledger of this rule set; an error where the folder has another one's alone."""
    return spark.read.parquet(f"{folder}/rules={version()}")


def rejected(policy: str) -> Column:
    """True where the policy's mask meets a failure bit."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def apply_policy(docs: DataFrame, policy: str = POLICY, text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with their own columns alone, as they were."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = ledger(whole, f"row.`{text}`").filter(~rejected(policy))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def ablation(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that fail no other (rule, n_failed, n_only).

    The ledger is first counted by its bits (2 ** rules groups at most), then read bit by bit.
    """
    by_bits = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("long").alias("bit")) for n in POLICIES[policy]])
    each = by_bits.select("bits", "n", F.explode(rules).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).alias
    return each.groupBy(F.col("r.rule").alias("rule")).agg(count(hit)("n_failed"), count(F.col("bits") == F.col("r.bit"))("n_only"))


def verdicts(led: DataFrame, policy: str = POLICY) -> DataFrame:
    """Of a ledger: its rows with base_failed, and kept by the base rules and the policy."""
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~(base | rejected(policy))).alias("kept"), "fail_bits")


def policy_counts(led: DataFrame) -> DataFrame:
    """policy, n_kept, n_rejected: what each policy makes of a ledger, in one pass over its bits."""
    by_bits = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    every = F.array(*[F.struct(F.lit(name).alias("policy"), F.lit(mask(rules)).cast("long").alias("mask")) for name, rules in POLICIES.items()])
    out = F.col("fail_bits").bitwiseAND(F.col("p.mask")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return by_bits.select("fail_bits", "n", F.explode(every).alias("p")).groupBy(F.col("p.policy").alias("policy")).agg(count(~out).alias("n_kept"), count(out).alias("n_rejected"))


def report(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """Contract rows of ``documents``, read from its stored ledger: doc_id, measurements, base_failed, kept; and fail_bits."""
    return verdicts(read_ledger(docs.sparkSession, write_ledger(docs)), policy)
