"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and
one bit for each failed rule; a policy is a versioned mask of those bits, so a new
policy or an ablation is bitwise arithmetic on the ledger and never reads a text again.

Columns of documents that the ledger does not need are passed on unless they clash with
its own names; then the ledger's value wins. A null or empty text has no words: all its
counts are 0 and it fails the base rules. Repeated rows are judged row by row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, each, freed

SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = ASCII_SPACE + bytes(range(0x80, 0xC0))  # white space and the later bytes of a character
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """Fails where `fails` (SQL over the measurements) is true. The bit never changes."""

    bit: int
    name: str
    fails: str


#: Integer arithmetic only, so that any engine gives the same bits.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 20 * n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "capitals", "n_letters >= 50 AND 100 * n_upper > 60 * n_letters"),
    Rule(5, "long_words", "word_chars > 25 * n_words"),
    Rule(6, "short_words", "word_chars < 2 * n_words"),
)
BASE = 0b11
#: A policy rejects a document that fails any rule of its mask. Versions are only added.
POLICIES = {"base-1": BASE, "strict-1": 0b1111111, "web-1": 0b1110111}
PRODUCTION = "web-1"


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() takes exactly the six ASCII white space characters
    n = len(words)
    word_chars = len(raw.translate(None, _NOT_CHARS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = -1  # last word position already counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 2 - max(covered, i - 1)
                    covered = i + 2
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, len(lines), upper, upper + lower


def with_measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """One pass over the texts; `keep` names the columns to pass on (default all)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    src = docs.select(*[F.col(f"`{c}`") for c in kept if c != text], F.col(f"`{text}`").cast("string").alias(text))
    out_schema = [f for f in src.schema.fields if f.name in kept]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema), *(f"{m} bigint" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*map(measure, each(b.column(text))))) or [()] * len(MEASURES)
            arrays = [b.column(f.name) for f in out_schema] + [pa.array(g, pa.int64()) for g in got]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f.name for f in out_schema), *MEASURES])

    return src.mapInArrow(freed(run), schema)


def failed_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    total = F.lit(0).cast("bigint")
    for r in rules:
        total = total.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("bigint"))
    return total


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Documents with their measurements and `failed_bits`. Write it once, use it for any policy."""
    return with_measures(docs, text, keep).withColumn("failed_bits", failed_bits())


def passes(mask: int) -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask).cast("bigint")) == 0


def apply_policy(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """Adds base_failed and kept under a policy version."""
    return led.withColumns({"base_failed": ~passes(BASE), "kept": passes(POLICIES[version] | BASE)})


def ablation(led: DataFrame, version: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that would
    be kept without it. One aggregate over the bits; one row per rule."""
    mask = POLICIES[version] | BASE
    rules = [r for r in RULES if mask >> r.bit & 1]
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask).cast("bigint"))
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(bits == 0).alias("kept")]
    for r in rules:
        one = F.lit(1 << r.bit).cast("bigint")
        counts += [F.count_if(bits.bitwiseAND(one) != 0).alias(f"f{r.bit}"), F.count_if(bits == one).alias(f"o{r.bit}")]
    rows = F.array(*[
        F.struct(F.lit(version).alias("policy"), F.lit(r.name).alias("rule"), F.col("n").alias("documents"),
                 F.col(f"f{r.bit}").alias("failed"), F.col(f"o{r.bit}").alias("failed_alone"),
                 (F.col("kept") + F.col(f"o{r.bit}")).alias("kept_without"))
        for r in rules
    ])
    return led.agg(*counts).select(F.inline(rows))
