"""Quality rules: text statistics, and an ordered decision list learned by sequential covering.

``statistics`` computes plain counts of whole texts. ``learn_rules`` grows conjunctions of
thresholds on them that single out bad documents, prunes each on held-back rows, and
takes the covered rows out before the next. ``verdict`` writes the list as ordered Spark
conditions, so that a rule can be read and applied anywhere.

Learning sees at most ``SAMPLE`` labelled rows (the lowest hashes of ``doc_id``), and only
their statistics; the rules are applied to every document.

Defined results: a null or wordless text has counts of 0 and fails the base test; a
document labelled twice takes the lower label, null labels are ignored; without labels of
both classes there are no rules; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from penmark.llm.common import lowest_hashes, texts_in, windows, word_hashes
from penmark.session import staged

SAMPLE = 20_000
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _counts(text: str | None) -> tuple[int, int, int, int, int]:
    words, start, end, data = word_hashes(text, fold=False, spans=True)
    if not len(words):
        return 0, 0, int(SYMBOLS[data].sum()), 0, 0
    # Code points in words: bytes inside words that do not continue a character.
    leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = int((leads[end] - leads[start]).sum())
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    runs = windows(words, 3)
    repeated = 0
    if len(runs):
        _, place, often = np.unique(runs, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(often[place] > 1)
        hit = np.zeros(len(words), bool)
        for i in range(3):
            hit[twice + i] = True
        repeated = int(hit.sum())
    return len(words), chars, int(SYMBOLS[data].sum()), again, repeated


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the five counts of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in texts_in(batches):
            counts = np.array([_counts(text) for text in texts], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, counts.T)], ["doc_id", *STATS])

    fields = ", ".join(f"{name} long" for name in STATS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, {fields}")


def ratios() -> dict[str, Column]:
    """What rules may test: the counts and their shares."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeated_share": F.col("n_repeat_words") / n,
    }


def base_failed() -> Column:
    """Too short, or mostly repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        value = ratios()[self.feature]
        return value > self.limit if self.above else value <= self.limit

    def mask(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.feature] > self.limit if self.above else values[self.feature] <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


@dataclass(frozen=True)
class Rule:
    """A document that passes all tests is bad; ``precision`` is measured on the held-back rows."""

    tests: tuple[Test, ...]
    precision: float

    def __str__(self) -> str:
        return " and ".join(map(str, self.tests)) + f"  ({self.precision:.3f})"


def _mask(tests, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(lambda a, b: a & b, (t.mask(values) for t in tests), np.ones(n, bool))


def _grow(values: dict[str, np.ndarray], bad: np.ndarray, max_tests: int, cuts: int) -> list[Test]:
    """Add the test of highest information gain until no good row is covered."""
    tests: list[Test] = []
    inside = np.ones(len(bad), bool)
    while len(tests) < max_tests and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), inside.sum()
        best: tuple[float, Test | None] = (1e-9, None)
        for feature, x in values.items():
            here = x[inside]
            y = bad[inside]
            for limit in np.unique(np.quantile(here, np.linspace(0, 1, cuts + 2)[1:-1], method="lower")):
                for above in (True, False):
                    m = here > limit if above else here <= limit
                    p, n = y[m].sum(), m.sum()
                    if p:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        best = max(best, (float(gain), Test(feature, above, float(limit))), key=lambda b: b[0])
        if best[1] is None:
            break
        test = best[1]
        above = values[test.feature][inside & (values[test.feature] > test.limit)]
        if len(above):  # halfway to the next value there is: the same rows, a wider margin
            test = Test(test.feature, test.above, float((test.limit + above.min()) / 2))
        # A stricter limit takes the place of an earlier one on the same side.
        tests = [t for t in tests if (t.feature, t.above) != (test.feature, test.above)] + [test]
        inside &= test.mask(values)
    return tests


def _prune(tests: list[Test], values: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """Drop last tests while the value (p - n) / (p + n) on held-back rows does not fall."""

    def worth(k: int) -> float:
        y = bad[_mask(tests[:k], values, len(bad))]
        return (2 * y.sum() - len(y)) / len(y) if len(y) else -1.0

    best = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
    return tests[:best]


def learn_rules(
    labelled: DataFrame, sample: int = SAMPLE, max_rules: int = 12, max_tests: int = 4, cuts: int = 63, precision: float = 0.9
) -> list[Rule]:
    """An ordered list from rows with the five counts and ``quality`` (0 is bad).

    Two thirds of the rows grow a rule, the rest prune and measure it; a rule that is right
    on fewer than ``precision`` of the held-back rows it covers ends the search.
    """
    rows = labelled.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), *[F.min(c).alias(c) for c in STATS]
    )
    rows = staged(rows)
    rows = lowest_hashes(rows, "doc_id", rows.count(), sample)
    data = rows.select("quality", *[v.alias(k) for k, v in ratios().items()]).toPandas()  # at most ``sample`` rows
    names = list(ratios())
    data = data.sort_values(["quality", *names]).sample(frac=1.0, random_state=11).reset_index(drop=True)
    bad = data["quality"].to_numpy() == 0
    values = {name: data[name].to_numpy(float) for name in names}
    grow = np.arange(len(bad)) % 3 != 0
    rules: list[Rule] = []
    while len(rules) < max_rules and bad[grow].any() and (~bad[grow]).any():
        side = lambda keep: {k: v[keep] for k, v in values.items()}
        tests = _grow(side(grow), bad[grow], max_tests, cuts)
        if not tests or not (~grow).any():
            break
        tests = _prune(tests, side(~grow), bad[~grow])
        hit = bad[~grow][_mask(tests, side(~grow), int((~grow).sum()))]
        if not len(hit) or hit.mean() < precision:
            break
        rules.append(Rule(tuple(tests), float(hit.mean())))
        left = ~_mask(tests, values, len(bad))
        values, bad, grow = side(left), bad[left], grow[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that fits, else 0."""
    out = None
    for n, rule in enumerate(rules, 1):
        fits = reduce(lambda a, b: a & b, (t.column() for t in rule.tests))
        out = F.when(fits, n) if out is None else out.when(fits, n)
    return F.lit(0) if out is None else out.otherwise(0)


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The counts with ``base_failed``, ``rule`` and ``kept``."""
    rows = stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
