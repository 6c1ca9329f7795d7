"""Document quality rules as a short-circuit cascade of native expressions.

Every rule is a Boolean column that is true where a document fails. The rules' costs and
rejection rates are estimated on a sample; the cascade then asks the rule that rejects most per
unit of cost first, and a document that has failed one rule is not asked the next.
The order never changes a verdict, only the work.

Nulls: a null text has no words, so it fails ``too_few_words``. A null in any other column is
carried along. Empty tables give empty results; repeated rows are judged one by one; columns of
the input whose names clash with an output column are replaced by it.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qrelia.llm.tables import fresh_names
from qrelia.session import durable

SPACES = r" \t-\r"  # inside a character class: blank and U+0009 to U+000D
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SHORT_LIST = 200
SAMPLE_ROWS = 2000


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` match the class ``chars``."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))


def words_of(text: Column) -> Column:
    """Runs of anything but the six ASCII white-space characters."""
    return F.array_remove(F.split(text, f"[{SPACES}]+"), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(f"[^{SPACES}]"))


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(values: Column, f) -> Column:
    """``f`` over each element and its successor."""
    n = F.size(values)
    return F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), f)


def window_hashes(words: Column) -> Column:
    """A hash for each five-word window, in order."""

    def of_word_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = _let(F.transform(words, lambda w: F.xxhash64(w)), of_word_hashes)
    return F.when(F.size(words) < WINDOW, F.array().cast("array<long>")).otherwise(hashes)


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside a five-word window that occurs twice or more, first occurrence included.

    Windows whose hash repeats are sorted by hash; neighbours with equal hashes are compared word by
    word. A long list of repeated hashes would be slow to search, so all windows are sorted then.
    """

    def window(i: Column) -> Column:
        return F.slice(words, i, WINDOW)

    def twins(a: Column, b: Column) -> Column:
        same = (a["h"] == b["h"]) & (window(a["i"]) == window(b["i"]))
        return F.when(same, F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))

    def covered(places: Column) -> Column:
        gaps = _pairs(places, lambda a, b: F.least(F.lit(WINDOW), b - a).cast("long"))
        return F.when(F.size(places) == 0, F.lit(0).cast("long")).otherwise(_sum_of(gaps) + WINDOW)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
    twice = F.filter(_let(F.sort_array(hashes), lambda s: _pairs(s, lambda a, b: F.when(a == b, a))), lambda h: h.isNotNull())
    candidates = _let(
        F.array_distinct(twice),
        lambda t: F.filter(pairs, lambda p: (F.size(t) > SHORT_LIST) | F.array_contains(t, p["h"])),
    )
    places = F.sort_array(F.array_distinct(F.flatten(_let(F.sort_array(candidates), lambda p: _pairs(p, twins)))))
    return _let(places, covered)


def base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Each list stands in a projection of its own, which Spark then evaluates once per row. Equal windows have
    equal hashes, so as many distinct hashes as windows means that none repeats; only other
    documents pay for looking closer.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines, hashes, unique = fresh_names(df, "words", "lines", "hashes", "unique")
    listed = (
        df.withColumns({words: words_of(body), lines: lines_of(body)})
        .withColumn(hashes, window_hashes(F.col(words)))
        .withColumn(unique, F.size(F.array_distinct(hashes)) == F.size(hashes))
    )
    repeated = F.when(F.col(unique), F.lit(0).cast("long")).otherwise(repeated_words(F.col(words), F.col(hashes)))
    counts = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": _count(body, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated,
    }
    return listed.withColumns(counts).drop(words, lines, hashes, unique)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules(text: str = "text") -> dict[str, Column]:
    """Rules beyond the base rule; each is true where a document fails."""
    body = F.coalesce(F.col(text), F.lit(""))
    n_words = F.greatest(F.col("n_words"), F.lit(1))
    letters = _count(body, r"\p{L}")
    capitals = _count(body, r"\p{Lu}")
    lines = F.greatest(F.size(lines_of(body)), F.lit(1))
    return {
        "symbols": F.col("n_symbols") > 0.3 * n_words,
        "word_length": ~(F.col("word_chars") / n_words).between(2.0, 15.0),
        "repeated_lines": F.col("n_dup_lines") > 0.3 * lines,
        "capitals": capitals > 0.4 * F.greatest(letters, F.lit(1)),
        "few_letters": letters < 0.6 * F.greatest(F.col("word_chars"), F.lit(1)),
        "shouting": _count(body, "!") > 0.3 * n_words,
    }


def cascade_order(sample: DataFrame, rules: Mapping[str, Column]) -> list[dict]:
    """Rules by rejected rows per second on ``sample``, best first; ties by name."""
    rows = sample.count()
    measured = []
    for name, fails in sorted(rules.items()):
        began = time.perf_counter()
        rejected = sample.select(F.sum(F.coalesce(fails, F.lit(True)).cast("long")).alias("n")).first()["n"] or 0
        cost = max(time.perf_counter() - began, 1e-6)
        measured.append({"rule": name, "cost": cost, "selectivity": rejected / max(rows, 1), "rate": rejected / cost})
    return sorted(measured, key=lambda m: (-m["rate"], m["rule"]))


def cascade(rules: Mapping[str, Column], order: list[str]) -> Column:
    """Name of the first rule that a document fails, else null; later rules are then not asked."""
    first = F.when(base_failed(), F.lit("base"))
    return reduce(lambda c, name: c.when(F.coalesce(rules[name], F.lit(True)), F.lit(name)), order, first)


def quality_rules(
    df: DataFrame,
    text: str = "text",
    rules: Mapping[str, Column] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 7,
) -> DataFrame:
    """``df`` with the five counts, ``base_failed``, ``failed_rule`` and ``kept``.

    ``sample_rows`` bounds the sample for costs and selectivities; it decides only the order.
    """
    rules = default_rules(text) if rules is None else dict(rules)
    total = df.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    counted = base_counts(df, text)
    sample = durable(base_counts(df.sample(fraction=share, seed=seed), text).where(~base_failed()))
    order = [m["rule"] for m in cascade_order(sample, rules)]
    judged = counted.withColumn("base_failed", base_failed()).withColumn("failed_rule", cascade(rules, order))
    return judged.withColumn("kept", F.col("failed_rule").isNull())
