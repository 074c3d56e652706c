"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule rejects a document. Rules are measured on a sample: its rejection rate,
and the time it adds to a scan of the sample. The cascade runs them in the order
of rejections per second, and a document that one rule rejects is not shown to the
next. The verdict doesn't depend on the order; only the work does.

Defined results: null text counts as empty (no words, rejected by the word count);
rows are judged one by one, so repeated rows and ties get equal verdicts; an empty
table gives an empty result; other columns, whatever their names, pass unchanged.
Texts are judged whole, at any length.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain

#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
#: ASCII white space, and anything else.
WHITE, WORDS = r"[ \t-\r]", r"[^ \t-\r]"
#: Rows of the sample on which cost and selectivity are measured.
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class TextColumns:
    """What rules may use: the text, its words, lines with a word, sorted windows, and measures.

    A measure is an expression over the text, or the column of that name where
    ``measured`` says that the frame already has it.
    """

    text: Column
    words: Column
    lines: Column
    windows: Column
    measured: frozenset[str] = frozenset()

    def measure(self, name: str) -> Column:
        return F.col(name) if name in self.measured else MEASURES[name](self)


@dataclass(frozen=True)
class Rule:
    """A named rule; ``reject`` gives a boolean column, true for a bad document."""

    name: str
    reject: Callable[[TextColumns], Column]


@dataclass(frozen=True)
class Estimate:
    """A rule's measures on the sample."""

    rule: Rule
    rejected: float
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != F.lit(""))


def lines_of(text: Column) -> Column:
    """The \\n-split lines that hold a word, as they are."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORDS))


def packed_windows(words: Column) -> Column:
    """For each 3-word window its hash, the low 24 bits replaced by its position; sorted.

    Windows with equal high bits are neighbours then, and a plain array of longs sorts
    fast. Null for texts of fewer than 4 words; of over 2^24 words, the low 40 bits.
    """
    n = F.size(words)

    def packed(bits: int) -> Column:
        low = (1 << bits) - 1

        def window(w: Column, i: Column) -> Column:
            h = F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
            return h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

        return F.sort_array(F.slice(F.transform(words, window), F.lit(1), n - 2))

    return F.when(n < 4, F.lit(None)).when(n <= 1 << 24, packed(24)).otherwise(packed(40))


def repeat_words(words: Column, packed: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    ``packed`` are the text's :func:`packed_windows`. Repeated windows have neighbours
    with equal high bits; those few are sorted by their words and compared exactly.
    """

    def count(bits: int) -> Callable[[Column], Column]:
        def alike(x: Column, y: Column) -> Column:
            return F.shiftrightunsigned(x.bitwiseXOR(y), bits) == 0

        def window(x: Column) -> Column:
            i = x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
            text = F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            return F.struct(text.alias("text"), i.alias("at"))

        def covered(s: Column) -> Column:
            def equal(x: Column, k: Column) -> Column:
                before, after = F.get(s, k - 1)["text"], F.get(s, k + 1)["text"]
                return F.coalesce(x["text"] == before, F.lit(False)) | F.coalesce(x["text"] == after, F.lit(False))

            three = F.transform(F.filter(s, equal), lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
            return F.size(F.array_distinct(F.flatten(three)))

        def exact(p: Column) -> Column:
            found = F.filter(
                p, lambda x, k: F.coalesce(alike(x, F.get(p, k - 1)), F.lit(False)) | alike(x, F.get(p, k + 1))
            )
            return _let(F.sort_array(F.transform(found, window)), covered)

        def repeated(p: Column) -> Column:
            none = F.size(F.filter(p, lambda x, k: alike(x, F.get(p, k + 1)))) == 0
            return F.when(none, F.lit(0)).otherwise(exact(p))

        return repeated

    small = F.size(words) <= 1 << 24
    return F.coalesce(F.when(small, _let(packed, count(24))).otherwise(_let(packed, count(40))), F.lit(0))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, as a lambda's bound variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def share(part: Column, whole: Column, limit: float) -> Column:
    """Whether part / whole is over the limit; false for an empty whole."""
    return part > whole * F.lit(limit)


#: n_dup_lines counts lines equal to an earlier one.
MEASURES: dict[str, Callable[[TextColumns], Column]] = {
    "n_words": lambda c: F.size(c.words).cast("long"),
    "n_lines": lambda c: F.size(c.lines).cast("long"),
    "word_chars": lambda c: F.char_length(F.array_join(c.words, "")).cast("long"),
    "n_symbols": lambda c: F.regexp_count(c.text, F.lit(SYMBOLS)).cast("long"),
    "n_dup_lines": lambda c: (F.size(c.lines) - F.size(F.array_distinct(c.lines))).cast("long"),
    "n_repeat_words": lambda c: repeat_words(c.words, c.windows).cast("long"),
    "exclamations": lambda c: F.char_length(c.text) - F.char_length(F.replace(c.text, F.lit("!"), F.lit(""))),
    "bullets": lambda c: F.size(F.filter(c.lines, lambda line: line.rlike(r"^[ \t]*[-*•‣●]"))),
    "ellipses": lambda c: F.size(F.filter(c.lines, lambda line: F.rtrim(line).endswith("...") | F.rtrim(line).endswith("…"))),
}

#: The rules of the base verdict.
BASE_RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda c: c.measure("n_words") < 50),
    Rule("repeated_windows", lambda c: c.measure("n_repeat_words") * 100 > c.measure("n_words") * 50),
)

#: Further rules with published thresholds, but for the repeated lines: half of the
#: lines instead of 0.3, as a text of three lines may well hold one of them twice.
RULES: tuple[Rule, ...] = (
    Rule("symbols", lambda c: share(c.measure("n_symbols"), c.measure("n_words"), 0.1)),
    Rule("short_words", lambda c: c.measure("word_chars") < c.measure("n_words") * 3),
    Rule("long_words", lambda c: c.measure("word_chars") > c.measure("n_words") * 10),
    Rule("repeated_lines", lambda c: share(c.measure("n_dup_lines"), c.measure("n_lines"), 0.5)),
    Rule("bullet_lines", lambda c: share(c.measure("bullets"), c.measure("n_lines"), 0.9)),
    Rule("ellipsis_lines", lambda c: share(c.measure("ellipses"), c.measure("n_lines"), 0.3)),
    Rule("exclamations", lambda c: share(c.measure("exclamations"), c.measure("n_words"), 0.3)),
)


def split_text(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, TextColumns]:
    """``docs`` as one struct column ``row`` beside its text, words and lines.

    The windows stay an expression: only rules that look at them pay for them.
    """
    text = F.coalesce(plain(text_col), F.lit(""))
    packed = docs.select(F.struct(*[plain(c) for c in docs.columns]).alias("row"), text.alias("text"))
    split = packed.withColumns({"words": words_of(F.col("text")), "lines": lines_of(F.col("text"))})
    return split, TextColumns(F.col("text"), F.col("words"), F.col("lines"), packed_windows(F.col("words")))


def estimate(
    docs: DataFrame, rules: Sequence[Rule], *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> list[Estimate]:
    """Measure each rule on about ``sample_rows`` rows, most rejections per second first.

    The sample is split into words and lines once; a rule's cost is the time of a pass
    with it less that of a pass without any, the better of two runs. Equal worth goes
    by name.
    """
    n = docs.count()
    picked = docs.select(plain(text_col).alias("text"))
    if n > sample_rows:
        picked = picked.sample(False, sample_rows / n, seed)
    split, c = split_text(picked)
    sample = split.select("text", "words", "lines").persist()
    try:
        total = max(1, sample.count())

        def run(column: Column) -> tuple[int, float]:
            passes = []
            for _ in range(2):
                began = time.perf_counter()
                hits = sample.agg(F.count_if(column).alias("hits")).first()["hits"]
                passes.append(time.perf_counter() - began)
            return hits, min(passes)

        _, bare = run(F.size(c.words) < 0)
        found = []
        for rule in rules:
            hits, seconds = run(rule.reject(c))
            found.append(Estimate(rule, hits / total, max(seconds - bare, 1e-4)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda e: (-e.worth, e.rule.name))


def verdict(c: TextColumns, order: Sequence[Rule]) -> Column:
    """True for a document that no rule rejects; later rules see only what earlier ones kept."""
    out = None
    for rule in order:
        rejected = F.coalesce(rule.reject(c), F.lit(False))
        out = F.when(rejected, F.lit(False)) if out is None else out.when(rejected, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def quality_filter(
    docs: DataFrame, *, rules: Sequence[Rule] = BASE_RULES + RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns."""
    order = [e.rule for e in estimate(docs, rules, text_col=text_col, sample_rows=sample_rows)]
    split, c = split_text(docs, text_col)
    # A filter isn't pushed below a projection with a row number that it looks at. Pushed,
    # it would split the text anew for every mention of its words, for each window even.
    numbered = split.withColumn("number", F.monotonically_increasing_id())
    return numbered.filter(verdict(c, order) & (F.col("number") >= 0)).select("row.*")


def quality_report(
    docs: DataFrame,
    *,
    rules: Sequence[Rule] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """The base measures of each row, the base verdict, and the cascade's.

    Columns: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. The cascade's rules run on what the base verdict kept.
    """
    order = [e.rule for e in estimate(docs, rules, text_col=text_col, sample_rows=sample_rows)]
    split, c = split_text(docs.select(plain(id_col), plain(text_col)), text_col)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    split, c = split.withColumn("windows", c.windows), replace(c, windows=F.col("windows"))
    measured = split.select("*", *[c.measure(name).alias(name) for name in base])
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    cascade = verdict(replace(c, measured=frozenset(base)), order)
    return measured.withColumn("base_failed", failed).select(
        F.col("row").getField(id_col).alias(id_col),
        *base,
        "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade).alias("kept"),
    )
