"""Text functions of the tutoring data as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The characters that count as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def add_content(cur: Column, new: Column) -> Column:
    """Append a stripped utterance: not repeated, with a full stop between sentences."""
    joined = F.concat(cur, F.when(cur.rlike(r"[.!?]$"), "").otherwise("."), F.lit(" "), new)
    return F.when((cur == "") | (cur == new), new).otherwise(joined)


def fold_content(pieces: Column) -> Column:
    """One text of an ordered array of utterances, each stripped once."""
    return F.aggregate(F.transform(pieces, strip), F.lit(""), add_content)


def correct_from_str(text: Column) -> Column:
    return F.when(text == "true", True).when(text == "false", False)


def correct_to_str(correct: Column) -> Column:
    return F.when(correct.isNull(), "na").when(correct, "true").otherwise("False")


def skills_to_str(kcs: Column, sep: str) -> Column:
    numbered = F.transform(kcs, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x))
    return F.when(F.size(kcs) == 0, "None").otherwise(F.array_join(numbered, sep))


def numbers_in(text: Column) -> Column:
    """Unsigned numbers in a text, thousands commas removed."""
    return F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def names_answer(text: Column, answer: Column) -> Column:
    """Whether some number in ``text`` is the answer; an answer that is no number must be one of the tokens."""
    value = answer.try_cast("double")
    close = F.exists(numbers_in(text), lambda x: F.abs(x.cast("double") - value) < 1e-7)
    return F.when(value.isNotNull(), close).otherwise(F.array_contains(numbers_in(text), answer))


def lm_result(text: Column) -> Column:
    """The JSON of the last fenced block or ``result = `` of a model's answer, null where there is none."""
    clean = F.replace(F.replace(F.replace(text, F.lit("\\("), F.lit("")), F.lit("\\)"), F.lit("")), F.lit("\\pi"), F.lit("pi"))
    fenced = F.regexp_extract(clean, r"(?s)^.*```json(.*)```", 1)
    assigned = F.regexp_extract(clean, r"(?s)^.*result = (.*)", 1)
    return F.trim(F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(assigned, F.lit(""))))


def lm_json(text: Column) -> Column:
    """The JSON value of a model's answer, or that of its key ``result`` if it has one, as canonical JSON text; null where
    there is none or it can't be parsed."""
    whole = F.try_parse_json(lm_result(text))
    return F.to_json(F.coalesce(F.try_variant_get(whole, "$.result", "variant"), whole))


# Families in the order in which they are tried, each with its alternatives of needles that must all occur.
STRICT_FAMILIES = (
    ("A: misunderstands what problem asks", (("what the problem is asking",),)),
    ("B: weak principles / when to apply", (("underlying ideas and principles",),)),
    ("C: relevant vs irrelevant info", (("relevant", "irrelevant"),)),
    ("D: wrong operation / number order", (("correct order",), ("correct operation",))),
    ("E: unsure which steps/procedures", (("steps or procedures",),)),
    ("F: cannot recognise problem type", (("recognize the problem type",),)),
)
LOOSE_FAMILIES = (
    ("A comprehension", (("what the problem is asking",),)),
    ("B principles", (("underlying ideas",), ("principles",))),
    ("C relevance", (("relevant", "irrelevant"),)),
    ("D wrong-operation", (("correct order",), ("correct operation",))),
    ("E steps", (("steps or procedures",),)),
    ("F problem-type", (("problem type",),)),
)


def _family(body: Column, families: tuple, other: str) -> Column:
    out = F.lit(other)
    for name, alternatives in reversed(families):
        found = F.lit(False)
        for needles in alternatives:
            every = F.lit(True)
            for x in needles:
                every = every & F.contains(body, F.lit(x))
            found = found | every
        out = F.when(found, name).otherwise(out)
    return out


def misconception_family(profile: Column) -> Column:
    """The strict rules, on the profile without its opening sentence."""
    return _family(F.lower(F.regexp_replace(F.trim(profile), r"^[A-Za-z]+ is a [^.]+\.\s*", "")), STRICT_FAMILIES, "OTHER")


def loose_family(profile: Column) -> Column:
    return _family(F.lower(profile), LOOSE_FAMILIES, "other")


def message(role: Column, content: Column) -> Column:
    """``Role: text`` on one line; line breaks become a backslash and an n."""
    return F.concat(F.initcap(role), F.lit(": "), F.replace(content, F.lit("\n"), F.lit("\\n")))
