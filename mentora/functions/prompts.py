"""Prompt texts and chat messages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mentora.functions.text import correct_to_str, skills_to_str, strip

# Texts of the prompts.
DESCRIPTIONS = {"comta": "the student is learning about math concepts."}
LEVEL_NAMES = {"domain": "DOMAINS", "cluster": "MATH CONCEPTS/SKILLS", "standard": "STANDARDS"}
BULLET = "\n- "
PROBLEM_LINE = "The student is trying to solve the following problem:"
NAMED_PROBLEM_LINE = ("The student, with the name ", ", is trying to solve the following problem:")
TURN_PAIR = "A teacher and a student are having a dialogue about math concepts. Below is a single turn pair from that dialouge, where the student responds to the teacher. In addition, there are knowledge components that represent the learning objectives in the teacher's question. Finally, it is identified if the student's response to the teacher was correct or incorrect.\nTeacher: "
IGNORED = -100


def described(template: str, dataset: str, descriptions: dict[str, str] = DESCRIPTIONS) -> str:
    """A system prompt with the data set's description in place of {desc}; an unknown data set raises ValueError."""
    if dataset not in descriptions:
        raise ValueError(f"no description of the data set {dataset}")
    return template.replace("{desc}", descriptions[dataset])


def problem_context(question: Column, solution: Column, wrong: Column) -> Column:
    """The problem with its right and wrong solution, each stripped and in tags; null if one of them is null."""
    block = lambda name, text: F.concat(F.lit(f"[BEGIN {name}]\n"), strip(text), F.lit(f"\n[END {name}]"))
    return F.concat(block("PROBLEM", question), F.lit("\n\n"), block("CORRECT SOLUTION", solution), F.lit("\n\n"), block("INCORRECT STUDENT SOLUTION", wrong))


def _with_context(context: Column | None, text: Column) -> Column:
    return text if context is None else F.concat(context, F.lit("\n\n"), text)


def annotation_prompt(dialogue: Column, last_turn: Column, context: Column | None = None) -> Column:
    n = last_turn.cast("string")
    plural = F.when(last_turn > 1, F.concat(F.lit("'s (1-"), n, F.lit(")"))).otherwise("")
    return _with_context(context, F.concat(dialogue, F.lit("\n\nYour final response should have an entry for exactly "), n, F.lit(" turn"), plural, F.lit(".")))


def level_prompt(dialogue: Column, level: str, options: Column, last_turn: Column, context: Column | None = None) -> Column:
    """Dialogue and bulleted options of a level: domain, cluster or standard; any other raises KeyError."""
    name, n = LEVEL_NAMES[level], last_turn.cast("string")
    text = F.concat(dialogue, F.lit(f"\n\n[BEGIN {name}]{BULLET}"), F.array_join(options, BULLET), F.lit(f"\n[END {name}]"))
    if level == "standard":
        text = F.concat(text, F.lit("\n\nThere should be exactly "), n, F.lit(" turn"), F.when(last_turn > 1, "s").otherwise(""), F.lit(" in your final result."))
    return _with_context(context, text)


def tracing_prompt(history: Column, kc: Column | None = None, context: Column | None = None) -> Column:
    """Prompt of one turn; a null or empty skill leaves the end open."""
    skill = F.lit("") if kc is None else F.when(F.coalesce(kc, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), kc))
    return _with_context(context, F.concat(history, F.lit("\n\nKnowledge Component:"), skill))


def turn_prompt(teacher: Column, student: Column, kcs: Column, correct: Column) -> Column:
    return F.concat(F.lit(TURN_PAIR), teacher, F.lit("\nStudent: "), student, F.lit("\nKnowledge Components: "), skills_to_str(kcs, " "), F.lit("\nStudent Correct: "), correct_to_str(correct))


def first_name(profile: Column) -> Column:
    """First word of a profile; Student for a null, empty or blank one."""
    return F.coalesce(F.nullif(F.regexp_extract(profile, r"^\s*(\S+)", 1), F.lit("")), F.lit("Student"))


def last_answer(text: Column) -> Column:
    """Last line of a solution, after its last written-out \\n, stripped."""
    return strip(F.element_at(F.split(F.element_at(F.split(text, "\n", -1), -1), r"\\n", -1), -1))


def prepared_messages(messages: Column, profile: Column, solution: Column, wrong: Column) -> Column:
    """Messages (role, content): the student's name in every system message, the solution at the end of the first one, and
    the wrong solution as a user message in second place, unless the first is a system message that it follows already.
    Null for fewer than two messages."""
    system = lambda m: m["role"] == "system"
    named = F.concat(F.lit(NAMED_PROBLEM_LINE[0]), first_name(profile), F.lit(NAMED_PROBLEM_LINE[1]))
    first = F.array_position(F.transform(messages, system), True) - 1

    def rewritten(m: Column, i: Column) -> Column:
        end = F.when(i == first, F.concat(F.lit("\nThe correct solution is as follows:\n"), solution, F.lit("\n"))).otherwise("")
        return F.struct(m["role"].alias("role"), F.when(system(m), F.concat(F.replace(m["content"], F.lit(PROBLEM_LINE), named), end)).otherwise(m["content"]).alias("content"))

    new = F.transform(messages, rewritten)
    said = F.struct(F.lit("user").alias("role"), wrong.alias("content"))
    there = system(F.get(new, F.lit(0))) & (F.get(new, F.lit(1))["role"] == "user") & F.get(new, F.lit(1))["content"].eqNullSafe(wrong)
    return F.when(F.size(messages) >= 2, F.when(there, new).otherwise(F.concat(F.slice(new, 1, 1), F.array(said), F.slice(new, 2, F.size(new)))))


def masked_labels(ids: Column, prompt_length: Column, size: Column) -> Column:
    """Token ids with the prompt's and the padding up to ``size`` replaced by IGNORED."""
    n = F.least(prompt_length, F.size(ids))
    return F.concat(F.array_repeat(F.lit(IGNORED), n), F.slice(ids, n + 1, F.size(ids)), F.array_repeat(F.lit(IGNORED), F.greatest(size - F.size(ids), F.lit(0))))
