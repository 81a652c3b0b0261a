"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``text_statistics`` derives the numbers that rules look at. A rule is a
condition under which a text is rejected. ``plan_cascade`` times every rule on
a sample of the texts that the base rule leaves, counts which rules reject which
of them, and picks the rules one after another: next comes the one with the
most rejections per cost among the texts that those before it leave.
``cascade`` nests them in that order, so a text rejected by one rule is never
shown to the rules after it. The order changes the cost alone: a text is kept
if no rule rejects it.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that ends words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
WINDOW = 3
#: A position takes so many low bits of a sort key; the hash of a window takes the rest.
PLACE_BITS = 20
#: Rows of the sample on which rules are timed, about.
SAMPLE_ROWS = 1000
#: A rule is timed over so many passes of the sample in one job, as one pass takes less than a job's own time varies.
PASSES = 2
#: Costs count in powers of this, and none below the least (seconds for a pass), so that the order doesn't hang on a measurement's noise.
COST_STEP, LEAST_COST = 4.0, 0.02


@dataclass(frozen=True)
class Rule:
    """Rejects where ``when`` (SQL over the text and its statistics) is true; cost (seconds) and rejects (share of the texts that the rules before leave) come from a sample."""

    name: str
    when: str
    cost: float = 1.0
    rejects: float = 0.0


#: Rules over the base statistics and the text. Ratios are products, so that no word means no rejection.
RULES = (
    Rule("symbols", "n_symbols * 10 > n_words"),
    Rule("duplicate_lines", "n_dup_lines * 10 > n_lines * 4"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("upper_case", "length(regexp_replace(text, '[^\\\\p{Lu}]', '')) * 10 > length(regexp_replace(text, '[^\\\\p{L}]', '')) * 6"),
    Rule("few_letters", "length(regexp_replace(text, '[^\\\\p{L}]', '')) * 10 < word_chars * 4"),
    Rule("exclamations", "(length(text) - length(replace(text, '!', ''))) * 2 > n_words"),
)


def _trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _key(window: Column) -> Column:
    return F.shiftright(window, PLACE_BITS)


def text_statistics(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``row`` (docs' columns), ``text`` and n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words (long).

    A null text counts as empty: all zero. n_repeat_words sorts the hashes of
    all windows with their places and looks at neighbours; texts in which two
    different windows share a hash, or with more windows than a place can
    number, sort the windows themselves, so the count is exact.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    words = F.when(_trim(F.col("text")) == "", F.array().cast("array<string>")).otherwise(F.split(_trim(F.col("text")), r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split("text", "\n"), lambda x: _trim(x) != "")
    cut = base.select("row", "text", words.alias("words"), lines.alias("lines"))

    def window(i: Column) -> list[Column]:
        return [F.get("words", i + k) for k in range(WINDOW)]

    last = F.size("words") - WINDOW
    places = F.when((last >= 0) & (last < (1 << PLACE_BITS)), F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(places, lambda i: F.shiftleft(F.xxhash64(*window(i)), PLACE_BITS) + i.cast("long"))
    s = cut.select("row", "text", "words", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.sort_array(hashed).alias("keys"))
    s = s.withColumn("twice", F.filter("keys", lambda x, i: F.coalesce(_key(x) == _key(F.get("keys", i - 1)), F.lit(False)) | F.coalesce(_key(x) == _key(F.get("keys", i + 1)), F.lit(False))))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")

    def differ(x: Column, y: Column) -> Column:
        same = [a == b for a, b in zip(window(place(x)), window(place(y)), strict=True)]
        return ~(same[0] & same[1] & same[2])

    mixed = F.size(F.filter("twice", lambda x, i: F.coalesce((_key(x) == _key(F.get("twice", i - 1))) & differ(x, F.get("twice", i - 1)), F.lit(False)))) > 0
    exactly = mixed | (F.size("words") - WINDOW >= (1 << PLACE_BITS))
    spelled = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.concat_ws(" ", *window(i), F.lpad(i.cast("string"), 10, "0")))
    s = s.withColumn("spelled", F.when(exactly, F.sort_array(spelled)))

    def head(x: Column) -> Column:
        return F.substring(x, F.lit(1), F.length(x) - 10)

    by_text = F.transform(F.filter("spelled", lambda x, i: F.coalesce(head(x) == head(F.get("spelled", i - 1)), F.lit(False)) | F.coalesce(head(x) == head(F.get("spelled", i + 1)), F.lit(False))), lambda x: F.right(x, F.lit(10)).cast("int"))
    s = s.withColumn("at", F.sort_array(F.when(F.col("spelled").isNotNull(), by_text).otherwise(F.transform("twice", place))))
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    symbols = F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))
    return s.select("row", "text", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"), "n_lines", "n_dup_lines", covered.cast("long").alias("n_repeat_words"))


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, base: str | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS, passes: int = PASSES) -> list[Rule]:
    """The rules in the order in which they are tried, with cost and share of rejected rows as measured on a sample.

    The sample is about sample_rows rows drawn at random, less those that base
    rejects; without any the order given stays. Equal rules keep the order
    given.
    """
    rows = docs.count()
    drawn = docs.sample(fraction=min(1.0, sample_rows / max(1, rows)), seed=17) if rows else docs
    stored = text_statistics(drawn, text=text).drop("row").persist()
    stored.count()  # before any filter, which would be pushed below and evaluate the statistics again and again
    sample = stored.filter(~F.coalesce(F.expr(base), F.lit(False))) if base else stored
    n = sample.count()
    again = sample.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))

    def seconds(of: str) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            # pass goes into the condition, so that each pass evaluates it anew
            again.agg(F.count_if(F.expr(f"({of}) and pass > 0"))).first()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds("n_words < 0")
    cost = {r.name: COST_STEP ** round(math.log(max((seconds(r.when) - idle) / passes, LEAST_COST) / LEAST_COST, COST_STEP)) * LEAST_COST for r in rules} if n else {}
    hit = F.array(*[F.coalesce(F.expr(r.when), F.lit(False)) for r in rules])
    patterns = [(r["hit"], r["n"]) for r in sample.groupBy(hit.alias("hit")).agg(F.count("*").alias("n")).collect()] if n else []  # at most as many as the sample has rows
    stored.unpersist()
    ordered, left = [], list(range(len(rules)))
    while n and left:
        total = max(1, sum(m for _, m in patterns))
        share = {k: sum(m for h, m in patterns if h[k]) / total for k in left}
        best = max(left, key=lambda k: (share[k] / cost[rules[k].name], -k))
        ordered.append(replace(rules[best], cost=cost[rules[best].name], rejects=share[best]))
        left.remove(best)
        patterns = [(h, m) for h, m in patterns if not h[best]]
    return ordered if n else list(rules)


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules are not evaluated then."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(rule.when), F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, base: str | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``row``, the statistics, ``base_failed`` and ``rejected_by`` (null: kept).

    base is a condition that rejects before any rule, as "base". Rows are
    judged alone, so repeated rows agree; an empty table gives no rows.
    """
    ordered = plan_cascade(docs, rules, base=base, text=text, sample_rows=sample_rows)
    failed = F.expr(base) if base else F.lit(False)
    found = text_statistics(docs, text=text)
    return found.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.when(failed, F.lit("base")).otherwise(cascade(ordered)).alias("rejected_by"))
