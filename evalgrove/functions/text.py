"""Text functions (T1-T17) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as sensitive, and the phrases that make a text harmless.
SENSITIVE = (
    r"\bcvv\b",
    r"\bpin\b",
    r"\bcard\s*number\b",
    r"\bpassword\b",
    r"\botp\b|\bone[- ]?time[- ]?(pass|code)\b",
    r"\b\d{4}\b",
    r"(?<!\d)\d{3,4}(?!\d)",
    r"\b\d{4}\s*\d{4}\s*\d{4}\s*\d{4}\b",
)
HARMLESS = ("koinly", "turbotax", "taxact", "hr block", "never share your", "never reveal your", "keep your", "protect your")
GREETINGS = ("hi", "hey", "hello", "good morning", "good afternoon")
POLITE = ("please", "thank", "thanks", "appreciate")

#: Everyday words; a token outside counts as a possible typo.
COMMON_WORDS = tuple(
    "a about account add after again all also am an and any app are as ask at back balance bank be been before being between but by call can card cash change check "
    "code come contact could country day days did different do does done email enough ever every fee find first for from get give go going good got had has have help "
    "her here him his how i if in into is it its just know last let like limit long look lost made make many may me money month more most much must my need never new "
    "no not now of off on one only open or order other our out over own pay payment people phone please receive right same see send she should show so some still stop "
    "such sure take tell than thank thanks that the their them then there these they thing think this time to too top transfer try two up us use very want was way we "
    "week well were what when where which while who why will with work would year yes you your".split()
)

STRIP = r"(?U)^\s+|\s+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def parse_action(response: Column) -> Column:
    """Answer, escalate, or format_violation, from the first line."""
    line = strip(F.substring_index(response, "\n", 1))
    found = F.lower(F.regexp_extract(line, r"(?iU)\A(?:ACTION:\s*(answer|escalate)\s*)\z", 1))
    return F.when(F.coalesce(found, F.lit("")) == "", "format_violation").otherwise(found)


def effective_action(action: Column) -> Column:
    """A format violation counts as an answer."""
    return F.when(action == "format_violation", "answer").otherwise(action)


def strip_action_line(response: Column) -> Column:
    """All but the first line, stripped; a single line stays as it is."""
    at = F.instr(response, "\n")
    return F.when(at > 0, strip(F.substring(response, at + 1, F.length(response)))).otherwise(response)


def sensitive(text: Column) -> Column:
    """Sensitive content, unless a harmless phrase is present."""
    low = F.lower(F.coalesce(text, F.lit("")))
    harmless = F.lit(False)
    for phrase in HARMLESS:
        harmless = harmless | F.contains(low, F.lit(phrase))
    return ~harmless & low.rlike("(?U)" + "|".join(f"(?:{p})" for p in SENSITIVE))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def has_question(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("?")), F.lit(False))


def has_exclamation(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("!")), F.lit(False))


def has_shout(text: Column) -> Column:
    return F.coalesce(text.rlike("[A-Z]{3,}"), F.lit(False))


def typo_share(text: Column, words: tuple[str, ...] = COMMON_WORDS) -> Column:
    """Share of lower-cased tokens that are not among ``words``."""
    own = tokens(F.lower(text))
    known = F.array(*[F.lit(w) for w in words])
    return F.coalesce(F.try_divide(F.size(F.filter(own, lambda t: ~F.array_contains(known, t))).cast("double"), F.size(own).cast("double")), F.lit(0.0))


def has_greeting(text: Column) -> Column:
    return F.coalesce(strip(F.lower(text)).rlike("^(" + "|".join(GREETINGS) + ")"), F.lit(False))


def is_polite(text: Column) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(POLITE)), F.lit(False))


def features(text: Column) -> dict[str, Column]:
    """The seven features by name."""
    return {
        "n_words": word_count(text),
        "question": has_question(text),
        "exclamation": has_exclamation(text),
        "shout": has_shout(text),
        "typo": typo_share(text),
        "greeting": has_greeting(text),
        "polite": is_polite(text),
    }


def duplicate_key(text: Column) -> Column:
    return strip(F.lower(text))


def unquote(text: Column) -> Column:
    """White space, then double quotes, then single quotes, off both ends."""
    return F.regexp_replace(F.regexp_replace(strip(text), '^"+|"+$', ""), "^'+|'+$", "")


def render(template: Column | str, **values: Column) -> Column:
    """``{name}`` by value, ``{{`` and ``}}`` as braces. Values are put in last, so braces inside them stay."""
    out = F.lit(template) if isinstance(template, str) else template
    out = F.replace(F.replace(out, F.lit("{{"), F.lit("\x01")), F.lit("}}"), F.lit("\x02"))
    pieces = F.transform(F.split(out, r"(?=\{)|(?<=\})"), lambda p: _filled(p, values))
    return F.replace(F.replace(F.array_join(pieces, ""), F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}"))


def _filled(piece: Column, values: dict[str, Column]) -> Column:
    out = piece
    for name, value in values.items():
        out = F.when(piece == "{" + name + "}", F.coalesce(value.cast("string"), F.lit(""))).otherwise(out)
    return out


def truncated(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def preview(text: Column, n: int = 100) -> Column:
    """P4."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def article_text(title: Column, content_text: Column, content: Column | None = None) -> Column:
    """P2."""
    body = F.coalesce(content_text, content if content is not None else F.lit(None), F.lit(""))
    return F.concat_ws("\n\n", F.coalesce(title, F.lit("")), body)


def context(hits: Column, separator: str = "\n\n---\n\n") -> Column:
    """Array of struct(rank, title, content) as one text, by rank."""
    lines = F.transform(F.sort_array(hits), lambda h: F.concat(F.lit("[Article "), h["rank"].cast("string"), F.lit("] "), h["title"], F.lit("\n"), h["content"]))
    return F.array_join(lines, separator)


def variant_id(seed: Column, family: Column, n: Column) -> Column:
    return F.concat_ws("_", seed, F.lit("variant"), family, n.cast("string"))


def parse_variant_id(case_id: Column) -> Column:
    """struct(seed_id, family_id, n); nulls where the id has another form."""
    part = lambda k: F.nullif(F.regexp_extract(case_id, r"^(.*)_variant_(.*)_(\d+)$", k), F.lit(""))
    return F.struct(part(1).alias("seed_id"), part(2).alias("family_id"), part(3).cast("int").alias("n"))
