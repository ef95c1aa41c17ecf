"""Quality rules as a short-circuit cascade.

Each rule rejects a document by figures of its whole text. A bounded sample tells what a rule costs and which share of the documents it
rejects; the rules then run in order of rejections per cost, and a document that one rejects is not shown to the next. The order changes
the time only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import NON_BLANK_RUN
from tradelens.session import checkpointed

#: Words of a window that must not repeat.
GRAM = 5
#: The symbol characters of the contract.
SYMBOLS = r"[#*$%&|<>]"
#: Documents of the sample, and how often each rule is timed on it.
SAMPLE, TIMES = 400, 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(words: Column, starts: Column) -> Column:
    """Words that lie in a window found twice or more. Windows are compared as text; equal ones are neighbours once sorted."""
    grams = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(words, i + 1, GRAM), " ").alias("g"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        return F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))

    places = F.sort_array(F.transform(_let(grams, repeated), lambda x: x["i"]))

    def summed(p: Column) -> Column:
        fresh = F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(GRAM).cast("bigint"), lambda total, k: total + F.least(F.lit(GRAM), F.get(p, k) - F.get(p, k - 1)))
        return F.when(F.size(p) < 2, F.lit(0).cast("bigint")).otherwise(fresh)

    return _let(places, summed)


def _repeated(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - GRAM)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]))
    # windows whose hashes all differ all differ, which is so in most texts; only the others are compared as text
    return F.when(F.size(words) < GRAM, F.lit(0).cast("bigint")).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(_covered(words, starts))))


def _share_of(array: str, pattern: str) -> Callable[[Features], Column]:
    return lambda f: F.size(F.filter(f(array), lambda x: x.rlike(pattern))).cast("bigint")


#: What rules are made of. ``words`` and ``lines`` (those with a word) are arrays, the rest are counts.
FEATURES: dict[str, Callable[[Features], Column]] = {
    "words": lambda f: F.regexp_extract_all(f.text, F.lit(NON_BLANK_RUN), F.lit(0)),
    "lines": lambda f: F.filter(F.split(f.text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    "n_words": lambda f: F.size(f("words")).cast("bigint"),
    "word_chars": lambda f: F.char_length(F.array_join(f("words"), "")).cast("bigint"),
    "n_symbols": lambda f: F.regexp_count(f.text, F.lit(SYMBOLS)).cast("bigint"),
    "n_dup_lines": lambda f: (F.size(f("lines")) - F.size(F.array_distinct(f("lines")))).cast("bigint"),
    "n_lines": lambda f: F.size(f("lines")).cast("bigint"),
    "n_repeat_words": lambda f: _repeated(f("words")) if "words" in f.held else _let(f("words"), _repeated),
    "n_letter_words": _share_of("words", r"[A-Za-z\x{80}-\x{10FFFF}]"),
    "n_shouted_words": _share_of("words", r"^[^a-z]*[A-Z][^a-z]*$"),
    "n_bullet_lines": _share_of("lines", r"^[\x20\x09-\x0D]*[-*\x{2022}]"),
    "n_open_lines": _share_of("lines", r"(?:[.]{3}|\x{2026})[\x20\x09-\x0D]*$"),
}
ARRAYS = ("words", "lines")
#: The counts of the contract.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Features:
    """Figures by name: a column where the row has it, else the expression that computes it."""

    def __init__(self, text: Column, held: Iterable[str] = ()):
        self.text, self.held = text, frozenset(held)

    def __call__(self, name: str) -> Column:
        return F.col(name) if name in self.held else FEATURES[name](self)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for documents that go. ``base`` rules are those of the contract."""

    name: str
    rejects: Callable[[Features], Column]
    base: bool = False


#: Thresholds of well-known public heuristics for web text. The first two are the contract's.
RULES = (
    Rule("few_words", lambda f: f("n_words") < 10, base=True),
    Rule("repeated_words", lambda f: f("n_repeat_words") * 100 > f("n_words") * 20, base=True),
    Rule("word_length", lambda f: (f("word_chars") < f("n_words") * 3) | (f("word_chars") > f("n_words") * 10)),
    Rule("symbols", lambda f: f("n_symbols") * 10 > f("n_words")),
    Rule("duplicate_lines", lambda f: f("n_dup_lines") * 100 > f("n_lines") * 30),
    Rule("letters", lambda f: f("n_letter_words") * 100 < f("n_words") * 80),
    Rule("shouting", lambda f: f("n_shouted_words") * 2 > f("n_words")),
    Rule("bullets", lambda f: f("n_bullet_lines") * 10 > f("n_lines") * 9),
    Rule("open_ends", lambda f: f("n_open_lines") * 10 > f("n_lines") * 3),
)


@dataclass(frozen=True)
class Estimate:
    """Seconds a document and share of the documents rejected, as the sample has them."""

    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / self.seconds


def _with_features(docs: DataFrame, text: str, names: Iterable[str]) -> DataFrame:
    """The named figures as columns; the arrays that more than one needs are computed once a row."""
    rows, held = docs, []
    for group in (ARRAYS, [n for n in FEATURES if n not in ARRAYS]):
        fresh = [n for n in group if n in names]
        rows = rows.withColumns({n: FEATURES[n](Features(F.col(text), held)) for n in fresh}) if fresh else rows
        held += fresh
    return rows


def estimate(texts: DataFrame, rules: Sequence[Rule] = RULES, held: Iterable[str] = (), sample: int = SAMPLE, times: int = TIMES, seed: int = 7) -> list[Estimate]:
    """Cost and selectivity of each rule on at most ``sample`` rows drawn from all of ``texts`` (column text).

    Figures in ``held`` are there when the rules run, so they cost a rule nothing. A rule's cost is the least of ``times`` timed runs over the sample,
    less that of a run without a rule. Of an empty table every rule rejects nothing. Times differ from run to run, and so may the order; results don't.
    """
    held = frozenset(held)
    rows = texts.count()
    drawn = texts.select("text").sample(min(1.0, 2 * sample / max(rows, 1)), seed).limit(sample)
    drawn = checkpointed(_with_features(drawn, "text", held).coalesce(1))
    figures = Features(F.col("text"), held)

    def run(*wanted: Column) -> tuple[float, int]:
        start = time.perf_counter()
        found = drawn.agg(F.count(F.lit(1)).alias("n"), *wanted).first()
        return time.perf_counter() - start, found[-1] or 0

    timed = {r.name: [run(F.count_if(F.coalesce(r.rejects(figures), F.lit(False)))) for _ in range(times)] for r in rules}
    idle, n = min(run() for _ in range(times))
    out = []
    for r in rules:
        seconds, rejected = min(timed[r.name])
        out.append(Estimate(r, max(seconds - idle, 1e-4) / max(n, 1), rejected / max(n, 1)))
    return out


def in_order(estimates: Sequence[Estimate]) -> list[Rule]:
    """Most rejections per second first; of equals the cheaper, then by name."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.worth, e.seconds, e.rule.name))]


def rejected_by(ordered: Sequence[Rule], figures: Features) -> Column:
    """Name of the first rule that rejects, null if none does. A branch is computed only where those before it let the document pass."""
    chain = F
    for rule in ordered:
        chain = chain.when(F.coalesce(rule.rejects(figures), F.lit(False)), F.lit(rule.name))
    return chain.otherwise(F.lit(None).cast("string")) if ordered else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, the counts of the contract, base_failed, kept, rejected_by.

    The counts are needed of every document; the cascade computes the rest only where it gets to it. A null or empty text has no words and
    fails. Rows that repeat, or share an id, are judged each by its own text, in one pass without a shuffle. An empty table gives no rows, other columns are not read.
    ``rejected_by`` names one of the rules that reject, by the order that was found; ``kept`` does not depend on the order.
    """
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = [*ARRAYS, *COUNTS]
    order = in_order(estimate(texts, rules, held, sample))
    figures = Features(F.col("text"), held)
    base = F.lit(False)
    for rule in rules:
        base = base | rule.rejects(figures) if rule.base else base
    rows = _with_features(texts, "text", held).withColumns({"base_failed": base, "rejected_by": rejected_by(order, figures)})
    return rows.select("doc_id", *COUNTS, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def passing(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The documents, all columns, that no rule rejects. Nothing is computed that the cascade does not get to."""
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    order = in_order(estimate(docs.select(clean.alias("text")), rules, sample=sample))
    return docs.filter(rejected_by(order, Features(clean)).isNull())
