"""Quality rules as a cascade that stops at the first rule a document breaks (operator 3).

What the rules cost and how much they reject is measured on a sample; the cascade runs the rules in order of rejections
per second. The order changes the time, never the verdict. Everything is built from DataFrame functions.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize

# White space of all word counts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"
# A word without any letter.
UNLETTERED = "(?<![^ \\t-\\r])[^\\p{L} \\t-\\r]+(?![^ \\t-\\r])"
CAPITALS = "\\p{Lu}"

MIN_WORDS = 10
WINDOW = 5
MAX_REPEATED_SHARE = 0.20
MAX_SYMBOLS_PER_WORD = 0.10
MEAN_WORD_LENGTH = (2, 15)
# So many duplicate lines are fine in a document of any length.
FEW_DUPLICATE_LINES = 2
MAX_DUPLICATE_LINE_SHARE = 0.30
MAX_UNLETTERED_SHARE = 0.30
MAX_CAPITAL_SHARE = 0.40

# The sample that orders the rules: its rows at most (a smaller table is its own sample), the texts that a timing judges by
# taking the sample over and over, unless their bytes are so many before, and how often each rule is timed.
SAMPLE_ROWS = 1000
TIMED_TEXTS, TIMED_BYTES = 2000, 4 << 20
TIMINGS = 3


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` reads it inside functions over arrays."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    """Words of a text that is not null, as an array."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def _windows(listed: Column, length: int) -> Column:
    """A hash of each window of ``length`` words."""

    def of(hashes: Column) -> Column:
        starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (length - 1), F.lit(0)))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, length)]))

    return _bind(F.transform(listed, lambda w: F.xxhash64(w)), of)


def _covered(windows: Column, length: int) -> Column:
    """Words inside windows that occur twice or more."""

    def repeated(ordered: Column) -> Column:
        hits = F.filter(
            ordered,
            lambda x, j: (F.get(ordered, j - 1)["h"] == x["h"]) | (F.get(ordered, j + 1)["h"] == x["h"]),
        )
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        parts = F.transform(starts, lambda p, j: F.least(F.lit(length), F.coalesce(F.get(starts, j + 1) - p, F.lit(length))))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda total, part: total + part)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bind(_bind(ordered, repeated), covered)


def repeated_words(listed: Column, length: int = WINDOW) -> Column:
    """Number of words in windows of ``length`` words that the array holds twice or more, the first included."""

    def of(windows: Column) -> Column:
        unique = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(unique, F.lit(0).cast("bigint")).otherwise(_covered(windows, length))

    return _bind(_windows(listed, length), of)


def line_figures(text: Column) -> Column:
    """``n_lines`` with a word, and how many of them equal an earlier line (``n_dup_lines``)."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")

    def counted(kept: Column) -> Column:
        count = F.size(kept).cast("bigint")
        return F.struct(count.alias("n_lines"), (count - F.size(F.array_distinct(kept))).alias("n_dup_lines"))

    return _bind(lines, counted)


class Figures:
    """The figures of a text that rules look at, each an expression that is made once; those known before are given.

    ``words`` is the array of words and ``n_words`` its size; both should be columns or bound values, since most rules
    use them.
    """

    def __init__(self, text: Column, words: Column, n_words: Column, **known: Column) -> None:
        self.text, self.words, self.n_words, self.known = text, words, n_words, known

    def _figure(self, name: str, made: Callable[[], Column]) -> Column:
        return self.known[name] if name in self.known else made()

    @property
    def word_chars(self) -> Column:
        return self._figure("word_chars", lambda: F.length(F.array_join(self.words, "")).cast("bigint"))

    @property
    def n_symbols(self) -> Column:
        return self._figure("n_symbols", lambda: _count(self.text, SYMBOLS))

    @property
    def n_repeat_words(self) -> Column:
        return self._figure("n_repeat_words", lambda: repeated_words(self.words))

    @property
    def lines(self) -> Column:
        """A struct of ``n_lines`` (with a word) and ``n_dup_lines``."""
        return self._figure("lines", lambda: line_figures(self.text))


@dataclass(frozen=True)
class Rule:
    """A rule and the column that says, from the figures of a text that is not null, whether it holds."""

    name: str
    holds: Callable[[Figures], Column]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def _few_duplicate_lines(figures: Figures) -> Column:
    return _bind(
        figures.lines,
        lambda lines: (lines["n_dup_lines"] <= FEW_DUPLICATE_LINES)
        | (lines["n_dup_lines"] <= MAX_DUPLICATE_LINE_SHARE * lines["n_lines"]),
    )


def _word_length(figures: Figures) -> Column:
    least, most = MEAN_WORD_LENGTH
    return _bind(figures.word_chars, lambda chars: (chars >= least * figures.n_words) & (chars <= most * figures.n_words))


BASE_RULES: tuple[Rule, ...] = (
    Rule("enough_words", lambda f: f.n_words >= MIN_WORDS),
    Rule("few_repeated_windows", lambda f: f.n_repeat_words <= MAX_REPEATED_SHARE * f.n_words),
)
RULES: tuple[Rule, ...] = (
    Rule("few_symbols", lambda f: f.n_symbols <= MAX_SYMBOLS_PER_WORD * f.n_words),
    Rule("word_length", _word_length),
    Rule("few_duplicate_lines", _few_duplicate_lines),
    Rule("lettered_words", lambda f: _count(f.text, UNLETTERED) <= MAX_UNLETTERED_SHARE * f.n_words),
    Rule("few_capitals", lambda f: _count(f.text, CAPITALS) <= MAX_CAPITAL_SHARE * F.length(f.text)),
)


def _bound(text: Column, use: Callable[[Figures], Column]) -> Column:
    """``use`` of the figures of a text that is not null; its words are found once."""
    return _bind(words(text), lambda listed: _bind(F.size(listed), lambda count: use(Figures(text, listed, count))))


@dataclass(frozen=True)
class Measured:
    """A rule with what the sample tells: the seconds that it takes and the texts that it rejects."""

    rule: Rule
    seconds: float
    rejected: int


def measure_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> list[Measured]:
    """Cost and rejections of each rule on a sample of at most ``SAMPLE_ROWS`` rows; an empty table gives none.

    Each rule is timed by itself on the same stored texts with their words, the whole sample once or more. Of several
    timings the shortest counts, less the shortest of a job that reads the same texts and judges nothing.
    """
    total = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = docs if total <= SAMPLE_ROWS else docs.sample(fraction=min(1.0, 2 * SAMPLE_ROWS / total), seed=11).limit(SAMPLE_ROWS)
    sample = materialize(drawn.select(text.alias("t"), words(text).alias("w")), "quality-sample")
    figures = Figures(F.col("t"), F.col("w"), F.size("w"))
    broken = [F.count_if(~rule.holds(figures)).alias(f"r{i}") for i, rule in enumerate(rules)]
    counts = sample.agg(F.count("*").alias("rows"), F.sum(F.octet_length("t")).alias("bytes"), *broken).first()
    if not counts["rows"]:
        return []
    times = max(1, min(TIMED_TEXTS // counts["rows"], TIMED_BYTES // max(counts["bytes"], 1)))
    texts = sample.repartition(1).select(F.explode(F.array_repeat(F.lit(0), times)).alias("n"), "t", "w")

    def seconds(judged: Column) -> float:
        taken = []
        for _ in range(TIMINGS):
            begun = time.perf_counter()
            texts.agg(F.count_if(judged)).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        return min(taken)

    idle = seconds((F.length("t") >= 0) & (F.size("w") >= 0))
    return [
        Measured(rule, max(seconds(rule.holds(figures)) - idle, 1e-4), counts[f"r{i}"]) for i, rule in enumerate(rules)
    ]


def order_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text") -> list[Rule]:
    """``rules`` by rejections per second as ``measure_rules`` tells, those of the least cost first where none is
    rejected; in the given order for an empty table."""
    measured = measure_rules(docs, rules, text_col)
    ordered = sorted(measured, key=lambda m: (-m.rejected / m.seconds, m.seconds))
    return [m.rule for m in ordered] or list(rules)


def cascade(figures: Figures, rules: Sequence[Rule]) -> Column:
    """Whether a text keeps all ``rules``; rules behind the first broken one are not evaluated."""
    judged = F.when(~rules[0].holds(figures), False)
    for rule in rules[1:]:
        judged = judged.when(~rule.holds(figures), False)
    return judged.otherwise(True)


def verdict(text: Column, rules: Sequence[Rule]) -> Column:
    """Whether a text that is not null keeps all ``rules``."""
    return _bound(text, lambda figures: cascade(figures, rules))


def measure(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the base figures, ``base_failed`` and ``kept`` to every row.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word that equal an
    earlier line) and ``n_repeat_words`` (words in windows of five that the text holds twice or more) are of whole
    texts. ``base_failed``: fewer than ten words, or more than a fifth of them repeated. ``kept``: neither that nor any
    broken rule of the cascade. A null or empty text has zeros, fails and is not kept. Windows are compared by 64-bit
    hashes inside one text.
    """
    ordered = order_rules(docs, rules, text_col)
    words_col, lines_col = "__llm_words", "__llm_lines"
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = docs.withColumn(words_col, words(text))
    raw = Figures(text, F.col(words_col), F.size(words_col))
    figures = listed.withColumns(
        {
            "n_words": F.size(words_col).cast("bigint"),
            "word_chars": raw.word_chars,
            "n_symbols": raw.n_symbols,
            lines_col: raw.lines,
            "n_repeat_words": raw.n_repeat_words,
        }
    ).withColumn("n_dup_lines", F.col(lines_col)["n_dup_lines"])
    known = {name: F.col(name) for name in ("word_chars", "n_symbols", "n_repeat_words")}
    counted = Figures(text, F.col(words_col), F.col("n_words"), lines=F.col(lines_col), **known)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED_SHARE * F.col("n_words"))
    judged = figures.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), False).otherwise(cascade(counted, ordered))
    return judged.withColumn("kept", kept).drop(words_col, lines_col)


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The rows that keep all rules, with their columns unchanged; the same rows as ``kept`` in ``measure``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(verdict(text, order_rules(docs, rules, text_col)))
