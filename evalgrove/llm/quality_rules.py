"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

All measures of a row and the verdict are one expression, in which parts that are used more than once are bound
by name (``_let``), so each is computed once a row; the operator adds no shuffle and nothing is gathered across
rows. A text is split into words once; repeated 5-word windows are found by hashing each window to 64 bits (two
XXH64 layers) and sorting the hashes of that one text only; stop words are counted by the words' hashes.

Defined results: a null or empty text has no words and no lines, so it fails the base rule of at
least ten words. Repeated rows are judged alike, each for itself. Extra columns are carried through
``apply_rules`` untouched; measures live in one struct, which replaces a column of its own name, and no other
column is made on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgrove.llm.common import word_array

#: Function words of the four languages of the corpus (fixed values).
STOP_WORDS = (
    "the of and to a in is that for it was on with be as by are this at from "
    "der die und in den von zu das mit auf sich des für ist im dem nicht ein eine als "
    "le la les de des du un une et en que qui est dans pour sur au par avec "
    "el los las y del que en un una por con para su al es no lo"
).split()

WINDOW = 5
#: A word of letters, with a comma or full stop at most.
LETTERS = r"(?<![^\x20\x09-\x0D])\p{L}++[,.]?(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [low, high]; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. ``min_words`` and ``repeat_words`` are the base rules.
RULES = (
    Rule("min_words", "n_words", low=10),
    Rule("repeat_words", "repeat_word_pct", high=20.0),
    Rule("max_words", "n_words", high=1_000_000),
    Rule("mean_word_length", "mean_word_chars", low=1.5, high=16.0),
    Rule("symbols_per_word", "symbols_per_word", high=0.1),
    Rule("stop_words", "stop_word_pct", low=4.0),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("shouting", "upper_ratio", high=0.4),
)
BASE = ("min_words", "repeat_words")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_upper", "n_letter_words", "repeat_word_pct", "mean_word_chars", "symbols_per_word", "dup_line_ratio", "stop_word_pct", "upper_ratio")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stop_forms() -> list[str]:
    """Every written form that counts as a stop word."""
    return [form + end for w in dict.fromkeys(STOP_WORDS) for form in (w, w.capitalize()) for end in ("", ",", ".")]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def measured(text: Column) -> Column:
    """A struct of all measures that rules may name."""
    stop = [F.xxhash64(F.lit(x)) for x in stop_forms()]

    def counts(raw: Column, hashes: Column, shingles: Column) -> Column:
        words, lines = raw["w"], raw["lines"]
        n_lines = F.size(lines).cast("long")
        repeated = F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.lit(0).cast("long")).otherwise(_covered(shingles))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            raw["n_symbols"].alias("n_symbols"),
            (n_lines - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            n_lines.alias("n_lines"),
            F.size(F.filter(hashes, lambda h: h.isin(*stop))).cast("long").alias("n_stop_words"),
            raw["n_upper"].alias("n_upper"),
            raw["n_letter_words"].alias("n_letter_words"),
        )

    def with_ratios(m: Column) -> Column:
        names = MEASURES[:9]
        return F.struct(
            *[m[k].alias(k) for k in names],
            _ratio(m["n_repeat_words"] * 100, m["n_words"]).alias("repeat_word_pct"),
            _ratio(m["word_chars"], m["n_words"]).alias("mean_word_chars"),
            _ratio(m["n_symbols"], m["n_words"]).alias("symbols_per_word"),
            _ratio(m["n_dup_lines"], m["n_lines"]).alias("dup_line_ratio"),
            # among words of letters, as numbers and codes have no language; one more than there are, so that a short text without any passes
            _ratio((m["n_stop_words"] + 1) * 100, m["n_letter_words"] + 1).alias("stop_word_pct"),
            _ratio(m["n_upper"], m["word_chars"]).alias("upper_ratio"),
        )

    def windows(hashes: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
        return F.when(F.size(hashes) >= WINDOW, every).otherwise(F.array().cast("array<bigint>"))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        count = lambda others: F.length(F.regexp_replace(t, others, "")).cast("long")
        raw = F.struct(word_array(t).alias("w"), lines.alias("lines"), count(r"[^#*$%&|<>]+").alias("n_symbols"), count(r"\P{Lu}+").alias("n_upper"), F.regexp_count(t, F.lit(LETTERS)).cast("long").alias("n_letter_words"))
        hashed = lambda r: _let(F.transform(r["w"], lambda w: F.xxhash64(w)), lambda h: _let(windows(h), lambda s: counts(r, h, s)))
        return _let(_let(raw, hashed), with_ratios)

    return _let(F.coalesce(text.cast("string"), F.lit("")), of)


def measures(df: DataFrame, text: str = "text", out: str = "measures") -> DataFrame:
    """Add a struct column ``out`` with all measures that rules may name."""
    return df.withColumn(out, measured(F.col(text)))


def _covered(shingles: Column) -> Column:
    """Words covered by windows that occur twice or more: sort (hash, place), keep places with an equal neighbour, add up new words."""
    ordered = F.sort_array(F.transform(shingles, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _let(ordered, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")))["n"]


def failed(rule: Rule, m: Column) -> Column:
    value = m[rule.measure]
    low = F.lit(False) if rule.low is None else value < F.lit(rule.low)
    high = F.lit(False) if rule.high is None else value > F.lit(rule.high)
    return low | high


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """A struct: every measure, ``failed`` (names of broken rules, in table order) and ``kept``."""
    broken = lambda m: F.array_compact(F.array(*[F.when(failed(r, m), F.lit(r.name)) for r in rules]))
    judged = lambda m, b: F.struct(*[m[k].alias(k) for k in MEASURES], b.alias("failed"), (F.size(b) == 0).alias("kept"))
    return _let(measured(text), lambda m: _let(broken(m), lambda b: judged(m, b)))


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """Add a struct ``out`` with the ``verdict``."""
    return df.withColumn(out, verdict(F.col(text), rules))


def keep(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that break no rule, with their own columns."""
    return df.filter(verdict(F.col(text), rules)["kept"])


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The query over ``documents`` in DuckDB SQL, from the same table of thresholds."""
    forms = ", ".join(f"'{x}'" for x in stop_forms())
    bounds = lambda r: " OR ".join([f"{r.measure} < {r.low}"] * (r.low is not None) + [f"{r.measure} > {r.high}"] * (r.high is not None))
    broken = ", ".join(f"CASE WHEN {bounds(r)} THEN '{r.name}' END" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        list_transform(range(1, len(words) - {WINDOW} + 2), lambda i: array_to_string(words[i : i + {WINDOW - 1}], ' ')) AS shingles FROM d),
x AS (SELECT doc_id, w, list(i) AS places FROM (SELECT doc_id, unnest(shingles) AS w, unnest(range(1, len(shingles) + 1)) AS i FROM s) GROUP BY doc_id, w HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT doc_id, unnest(places) AS i FROM x)) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines, len(list_filter(words, lambda x: x IN ({forms}))) AS n_stop_words, len(list_filter(words, lambda x: regexp_full_match(x, '\p{{L}}+[,.]?'))) AS n_letter_words, length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_upper FROM s LEFT JOIN r USING (doc_id)),
v AS (SELECT *, coalesce(n_repeat_words * 100 / nullif(n_words, 0)::DOUBLE, 0) AS repeat_word_pct, coalesce(word_chars / nullif(n_words, 0)::DOUBLE, 0) AS mean_word_chars,
        coalesce(n_symbols / nullif(n_words, 0)::DOUBLE, 0) AS symbols_per_word, coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE, 0) AS dup_line_ratio,
        (n_stop_words + 1) * 100 / (n_letter_words + 1)::DOUBLE AS stop_word_pct, coalesce(n_upper / nullif(word_chars, 0)::DOUBLE, 0) AS upper_ratio FROM m),
f AS (SELECT *, list_filter([{broken}], lambda x: x IS NOT NULL) AS failed_rules FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, len(failed_rules) = 0 AS kept, failed_rules FROM f
"""
