"""Quality rules as a short-circuit cascade, in Spark SQL functions alone.

Each rule is a named condition that rejects a document. On a bounded sample every rule's cost (seconds a document, beyond
those of a rule that does nothing) and selectivity (share rejected) are measured; the cascade asks the rules in the order of
rejection per cost, and a document meets no rule after the one that rejects it (CASE evaluates its branches in turn). The
order changes the cost alone: a document is kept if no rule rejects it. The five measures are part of the result and so are
made for every document; what the cascade saves is the rules that search the text.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import SPACE, fresh, stored

#: About how many rows cost and selectivity are measured on, how often each row is judged for a time, and how many times are taken.
SAMPLE_ROWS, REPEATS, TIMES = 2000, 1, 2
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
REPEAT_WINDOW = 5


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def full_lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))


def _without(text: Column, characters: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), characters, "")


def duplicate_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(word_hashes: Column, n: Column, k: int = REPEAT_WINDOW) -> Column:
    """A 64-bit hash of each window of k words, by its start."""
    return F.when(n < k, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(word_hashes, i + j) for j in range(k)))))


def repeated_words(hashes: Column, k: int = REPEAT_WINDOW) -> Column:
    """Words inside windows (given by hash) that are found twice or more: equal hashes stand side by side once sorted, and the
    starts of those that have an equal neighbour cover the words. Texts without an equal pair are not sorted."""
    no = F.lit(False)

    def starts_of_equal(s: Column) -> Column:
        beside = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], no)  # noqa: E731  outside the array: null
        flagged = F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), (beside(x, j + 1) | beside(x, j - 1)).alias("twice")))
        return F.array_sort(F.transform(F.filter(flagged, lambda x: x["twice"]), lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda at, j: F.least(F.lit(k), F.coalesce(F.get(starts, j + 1), at + k) - at))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  evaluates value once
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_cover = let(ranked, lambda s: let(starts_of_equal(s), covered))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(sorted_cover)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), over whole texts; null has no words.

    Columns of docs with these names are kept; ours get underscores then, and are the last five."""
    names = fresh(docs, *MEASURES)
    w, h, win = fresh(docs, "_words", "_hashes", "_windows")
    t = F.col(text)
    # Each array is made in a projection of its own, so that what is derived from it does not make it again.
    made = docs.withColumn(w, words(t)).withColumn(h, F.transform(F.col(w), lambda x: F.xxhash64(x)))
    made = made.withColumn(win, window_hashes(F.col(h), F.size(w)))
    length = F.length(F.coalesce(t, F.lit("")))
    return made.select(
        *docs.columns,
        F.size(w).cast("long").alias(names[0]),
        F.length(_without(t, " \t\n\x0b\x0c\r")).cast("long").alias(names[1]),
        (length - F.length(_without(t, SYMBOLS))).cast("long").alias(names[2]),
        duplicate_lines(full_lines(t)).alias(names[3]),
        repeated_words(F.col(win)).alias(names[4]),
    )


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def standard_rules(text: str = "text", measured: tuple[str, ...] | list[str] = MEASURES) -> dict[str, Column]:
    """Conditions that reject, over measures() of a document (by the names they have); the limits are those of common public
    rule sets for web text."""
    n, word_chars, n_symbols, n_dup_lines, n_repeat_words = map(F.col, measured)
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.size(full_lines(t))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    return {
        "few_words_or_repeats": base_failed(n, n_repeat_words),
        "symbols": 10 * n_symbols > n,
        "word_length": (word_chars > 40 * n) | (10 * word_chars < 15 * n),
        "duplicate_lines": (n_dup_lines > 1) & (100 * n_dup_lines > 30 * lines),
        "no_letters": 2 * count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*\p{L}") < n,
        "shouting": 10 * count(r"\p{Lu}") > 6 * count(r"\p{L}"),
        "exclamation": 10 * count("!") > 3 * n,
    }


def measured_order(sample: DataFrame, rules: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds) of each rule on a stored sample, by rejection per cost, the best first.

    Each time is the least of TIMES jobs that judge every row REPEATS times, less that of a rule that does nothing. Rules
    that cost nothing that can be measured count a ten-thousandth of a second. Equal values stay in the given order; on an
    empty sample the given order is kept."""
    again = sample.withColumn(fresh(sample, "_again")[0], F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def judged(reject: Column) -> tuple[int, int, float]:
        best = None
        for _ in range(TIMES):
            began = time.perf_counter()
            found = again.agg(F.count("*").alias("n"), F.count_if(reject).alias("hits")).first()
            seconds = time.perf_counter() - began
            best = seconds if best is None else min(best, seconds)
        return found["n"], found["hits"], best

    judged(F.lit(False))  # warms up
    nothing = judged(F.col(sample.columns[0]).isNull())[2]
    out = []
    for name, reject in rules.items():
        n, hits, seconds = judged(reject)
        out.append((name, hits / max(n, 1), max(seconds - nothing, 1e-4)))
    return sorted(out, key=lambda x: -x[1] / x[2])


def first_rejection(rules: dict[str, Column], order: list[str]) -> Column:
    """The name of the first rule in order that rejects, or null: later branches of CASE are not evaluated then."""
    case = F.when(F.coalesce(rules[order[0]], F.lit(False)), F.lit(order[0]))
    for name in order[1:]:
        case = case.when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return case


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About that many rows of docs, each by chance (all, if there are fewer): never more of one partition than its share."""
    return docs.sample(min(1.0, rows / max(docs.count(), 1)), seed=0)


def cascade(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with eight more columns: the five measures, base_failed, rejected_by (the rule that rejected first; null if kept) and
    kept, with underscores where docs has these names.

    kept does not depend on the measured order, rejected_by may. Null, empty and blank texts have no words and fail the base
    rule. Repeated rows each get the same verdict. An empty table gives none."""
    scored = measures(docs, text)
    measured = scored.columns[-5:]
    failed, rejected_by, kept = fresh(scored, "base_failed", "rejected_by", "kept")
    rules = standard_rules(text, measured)
    order = [name for name, *_ in measured_order(stored(measures(sampled(docs, sample_rows), text)), rules)]
    scored = scored.withColumn(failed, base_failed(F.col(measured[0]), F.col(measured[4])))
    return scored.withColumn(rejected_by, first_rejection(rules, order)).withColumn(kept, F.col(rejected_by).isNull())


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the four measures, base_failed and kept of every document."""
    return cascade(docs.select("doc_id", "text")).select("doc_id", *MEASURES, "base_failed", "kept")
