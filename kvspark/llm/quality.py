r"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in expression over the whole text, every rule a
comparison of a metric with a threshold, and the verdict their conjunction: no
shuffle, no user function. The plan is a chain of projections over the scan, as each
is compiled apart, and a ``Generate`` of one row each that keeps filters on the
verdict from repeating them.

The stop words are those of four languages, unless others are given: with them, texts in
other languages lack stop words and go. Without any list the rule is left out.

Words are ``[^\x20\x09-\x0D]+``; lines are split at ``\n`` and count when they
hold a word. Null text has no words and fails ``n_words``. Repeated rows are
judged alike, each on its own; ratios with an empty denominator are 0. Texts of any
length are judged whole, within what an array of the JVM holds. Columns of ``docs``
stay as they are, whatever their names; only one named ``quality`` is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvspark.llm.tables import fresh

SPACE = r"[\x20\x09-\x0D]+"
STOP_WORDS = {
    "en": "the of and to in is are was that for with as on be at by this it from or an",
    "de": "der die das und in zu den von mit ist des dem nicht ein eine auf für als auch es",
    "fr": "de la le les et des en un une du que est pour dans qui par sur au pas plus",
    "es": "el la de que y en los del se las por un con una para es al lo como su",
}


@dataclass(frozen=True)
class Rule:
    """``metric`` must be at least ``low`` and at most ``high``."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Metrics on the left are those of :func:`metrics`. Base rules come first.
BASE_RULES = (Rule("n_words", low=50), Rule("repeat_word_percent", high=50))
METHOD_RULES = (
    Rule("mean_word_length", low=2, high=12),
    Rule("symbol_word_ratio", high=0.1),
    Rule("unlettered_word_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.02),
    Rule("duplicate_line_ratio", high=0.4),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _matching(words: Column, pattern: str) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike(pattern))).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _neighbours(s: Column, key) -> Column:
    """Elements of the sorted array ``s`` that share their key with a neighbour."""
    return F.filter(
        s,
        lambda x, k: F.coalesce(key(x) == key(F.get(s, k - 1)), F.lit(False))
        | F.coalesce(key(x) == key(F.get(s, k + 1)), F.lit(False)),
    )


#: Bits of a packed window that hold its place; texts with more words are not packed.
PLACE_BITS = 24


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """``df`` with ``out``: words inside three-word windows that the text holds twice or more.

    Most texts repeat no window: as many distinct window hashes as windows prove
    it. In the others, a sort of plain longs (40 bits of the hash, 24 of the
    place) leaves the windows whose hash repeats, which holds every repeated
    window and next to nothing else. Those are sorted as strings with their
    places, so equal ones are neighbours; the places, sorted, then say how many
    words they cover. Each step is a column of its own, so sorts stay compiled.
    """
    w = F.col(words)
    size = F.size(w)
    hashes, keys, grams, places = (fresh(df, n) for n in ("__h", "__k", "__g", "__p"))
    steps = df.withColumn(
        hashes,
        F.transform(
            F.slice(w, F.lit(1), F.greatest(size - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)),
        ),
    )
    h = F.col(hashes)
    some = F.size(F.array_distinct(h)) < F.size(h)
    keyed = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long")))
    steps = steps.withColumn(keys, F.when(some & (size <= 1 << PLACE_BITS), F.sort_array(keyed)))
    k = F.col(keys)
    hashed = F.transform(
        _neighbours(k, lambda x: F.shiftright(x, PLACE_BITS)),
        lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int"),
    )
    candidates = F.when(size <= 1 << PLACE_BITS, hashed).otherwise(F.sequence(F.lit(0), F.greatest(size - 3, F.lit(0))))
    windows = F.transform(
        candidates,
        lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")),
    )
    steps = steps.withColumn(grams, F.sort_array(windows))
    steps = steps.withColumn(
        places, F.sort_array(F.transform(_neighbours(F.col(grams), lambda x: x["g"]), lambda x: x["i"]))
    )
    p = F.col(places)
    covered = F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1), x + 3) - x)),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return steps.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop(hashes, keys, grams, places)


def stop_forms(stop_words: Mapping[str, str]) -> list[str]:
    """The words of all lists as they are, capitalised and in capitals."""
    return sorted({f(w) for line in stop_words.values() for w in line.split() for f in (str, str.capitalize, str.upper)})


def metrics(words: Column, text: Column, repeated: Column, stop_words: Mapping[str, str] = STOP_WORDS) -> dict[str, Column]:
    """Named metrics of a text; ``words`` is that of :func:`words_of`, ``repeated`` that of :func:`with_repeated_words`."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = F.size(lines)
    n_words = F.size(words).cast("long")
    stops = stop_forms(stop_words)

    def per(count: Column, whole: Column) -> Column:
        return F.when(whole == 0, F.lit(0.0)).otherwise(count.cast("double") / whole)

    return {
        "n_words": n_words,
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated,
        "n_lines": n_lines.cast("long"),
        "n_bullet_lines": _matching(lines, r"^[\x20\x09-\x0D]*[-*•]"),
        "n_ellipsis_lines": _matching(lines, r"(\.\.\.|…)[\x20\x09-\x0D]*$"),
        "n_unlettered": F.regexp_count(
            text, F.lit(r"(?s)[^\p{L}\x20\x09-\x0D](?<![^\x20\x09-\x0D].)[^\p{L}\x20\x09-\x0D]*+(?!\p{L})")
        ).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stops))).cast("long"),
        "per": per,
    }


RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_word_ratio": ("n_symbols", "n_words"),
    "unlettered_word_ratio": ("n_unlettered", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "duplicate_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def _passes(rules: Sequence[Rule], metric: dict[str, Column]) -> Column:
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (metric[rule.metric] >= rule.low)
        if rule.high is not None:
            verdict = verdict & (metric[rule.metric] <= rule.high)
    return verdict


def quality_rules(
    docs: DataFrame,
    base: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = METHOD_RULES,
    text: str = "text",
    stop_words: Mapping[str, str] = STOP_WORDS,
) -> DataFrame:
    """``docs`` with a struct ``quality`` of all counts, ``base_failed`` and ``kept``.

    ``stop_words`` holds a list of words by language. An empty table gives an empty
    result with the same columns.
    """
    words, repeated, counted = (fresh(docs, n) for n in ("__words", "__repeated", "__counts"))
    if not stop_words:
        rules = [r for r in rules if r.metric != "stop_word_ratio"]
    counts = metrics(F.col(words), F.col(text), F.col(repeated), stop_words)
    per = counts.pop("per")
    scalars = F.struct(*[v.alias(k) for k, v in counts.items()])
    measured = with_repeated_words(docs.withColumn(words, words_of(F.col(text))), words, repeated)
    measured = measured.withColumn(counted, scalars)
    count = {k: F.col(counted)[k] for k in counts}
    metric = count | {k: per(count[a], count[b]) for k, (a, b) in RATIOS.items()}
    metric["repeat_word_percent"] = F.when(count["n_words"] == 0, F.lit(0.0)).otherwise(
        100 * count["n_repeat_words"] / count["n_words"]
    )
    failed = ~_passes(base, metric)
    judged = F.struct(
        *[c.alias(k) for k, c in count.items()],
        failed.alias("base_failed"),
        (~failed & _passes(rules, metric)).alias("kept"),
    )
    # Unnesting is a step that filters on the verdict don't pass; below it they would repeat every expression.
    judged = F.explode(F.array(judged))
    return measured.withColumn("quality", judged).drop(words, repeated, counted)
