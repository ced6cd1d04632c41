"""Prompts as column expressions. Their texts are parameters with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LABELS, strip

#: What every prompt says besides its question.
INSTRUCTION = "Answer with a single letter (A, B, C, or D)."
FREETEXT_INSTRUCTION = "Answer in one or two sentences."
SYSTEM = (
    "You are a medical exam assistant. Answer the multiple-choice question by selecting the single best option. "
    "Respond with only the letter of your chosen option."
)
CONTEXT_HEADER = "Use the following reference passages if they are relevant. If they are not relevant, rely on your own knowledge."
SEPARATOR = "\n\n---\n\n"
NO_ANSWER = "(no answer given)"
PLACEHOLDER = "(free-text item: no options)"

#: Rubrics for a judge, and their version, which travels with its grades. The replies that they
#: ask for are those that ``parse_score`` and ``parse_verdict`` read.
RUBRIC_VERSION = "agreement-1"
POINTWISE = (
    "Does the candidate reach the conclusion of the reference?\n2: yes, in whatever words. 1: in part, or beside a contradiction. "
    "0: no, or there is no answer.\nLength and style don't count.\n\nQuestion: {question}\n\nReference: {reference}\n\n"
    "Candidate: {candidate}\n\nEnd with one line, SCORE: and the grade."
)
PAIRWISE = (
    "Which answer agrees better with the reference? If neither does better, it's a tie.\nLength and style don't count.\n\n"
    "Question: {question}\n\nReference: {reference}\n\nAnswer A: {answer_a}\n\nAnswer B: {answer_b}\n\n"
    "End with one line, VERDICT: and A, B or TIE."
)


def format_options(options: Column) -> Column:
    """Labelled options, a line each; those beyond the labels are left out."""
    labels = F.array(*map(F.lit, LABELS))
    shown = F.slice(options, F.lit(1), F.lit(len(LABELS)))
    return F.array_join(F.transform(shown, lambda o, i: F.concat(F.get(labels, i), F.lit(". "), o)), "\n")


def format_context(passages: Column) -> Column:
    """The header and the passages, numbered from 1, with blank lines between."""
    blocks = F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), strip(p)))
    return F.concat(F.lit(CONTEXT_HEADER + "\n\n"), F.array_join(blocks, "\n\n"))


def with_context(body: Column, passages: Column | None) -> Column:
    """The context before the body, or the body alone where there are no passages."""
    if passages is None:
        return body
    return F.when(F.size(passages) > 0, F.concat(format_context(passages), F.lit(SEPARATOR), body)).otherwise(body)


def mcq_prompt(question: Column, options: Column, passages: Column | None = None) -> Column:
    body = F.concat(strip(question), F.lit("\n\n"), format_options(options), F.lit("\n\n" + INSTRUCTION))
    return with_context(body, passages)


def freetext_prompt(question: Column, passages: Column | None = None) -> Column:
    """The question without its options."""
    return with_context(F.concat(strip(question), F.lit("\n\n" + FREETEXT_INSTRUCTION)), passages)


def strip_context(prompt: Column) -> Column:
    """What follows the first separator; a prompt without one is unchanged."""
    at = F.instr(prompt, SEPARATOR)
    return F.when(at > 0, F.substr(prompt, at + len(SEPARATOR))).otherwise(prompt)


def query_text(question: Column, options: Column | None = None) -> Column:
    """What is searched for: the question, with its options if they're given."""
    return question if options is None else F.concat_ws(" ", question, F.array_join(options, " "))


def reference_answer(options: Column, answer_idx: Column) -> Column:
    """The stripped gold option; an item without a label is an error."""
    return F.when(answer_idx.isNull(), F.raise_error(F.lit("an item has no gold answer"))).otherwise(strip(F.get(options, answer_idx)))


def pair_as_question(question: Column, answer: Column, passage: Column, subject: Column) -> dict[str, Column]:
    """A question-answer pair as an item: the answer is its first option, a placeholder the second."""
    return {
        "question": strip(question), "options": F.array(strip(answer), F.lit(PLACEHOLDER)), "answer_idx": F.lit(0),
        "subject": F.coalesce(F.nullif(subject, F.lit("")), F.lit("Unknown")), "explanation": passage,
    }


def training_target(answer_idx: Column, rationale: Column | None = None) -> Column:
    """The letter of the answer, and after a blank line the rationale if there is one."""
    letter = F.get(F.array(*map(F.lit, LABELS)), answer_idx)
    if rationale is None:
        return letter
    return F.when(F.coalesce(rationale, F.lit("")) != "", F.concat(letter, F.lit("\n\n"), rationale)).otherwise(letter)


def chat_messages(user: Column, assistant: Column, system: str = SYSTEM) -> Column:
    """A training record: an array of role and content."""
    said = (("system", F.lit(system)), ("user", user), ("assistant", assistant))
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said])


def judge_prompt(rubric: str, **parts: Column) -> Column:
    """A rubric whose ``{name}`` places are filled; a blank candidate says that there is none."""
    out = F.lit(rubric)
    for name, part in parts.items():
        said = strip(F.coalesce(part, F.lit("")))
        if name.startswith(("candidate", "answer")):
            said = F.when(said == "", NO_ANSWER).otherwise(said)
        out = F.replace(out, F.lit("{" + name + "}"), said)
    return out
