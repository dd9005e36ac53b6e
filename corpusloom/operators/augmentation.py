"""Generated questions: prompts, batch completion by a user's model, parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WS, split_lines, strip

# The prompt wording, {n} and {text} to be filled in, and the list marks
# that are taken off an answer's lines.
QUESTION_PROMPT = (
    "Given the following text, generate {n} concise questions that a user "
    "might ask which can be directly answered by this text.\n"
    "Return ONLY the questions, one per line, without numbering.\n\nText:\n{text}"
)
LIST_MARKER = rf"^(?:[-*•]+{WS}*)?(?:\p{{Nd}}+[.)]{WS}+)?"


def question_prompts(
    chunks: DataFrame, count: int, keys: tuple[str, ...] = ("doc_id", "chunk_id")
) -> DataFrame:
    """(keys, prompt) per chunk; no rows when no questions are wanted."""
    if count <= 0:
        chunks = chunks.limit(0)
    head, tail = QUESTION_PROMPT.replace("{n}", str(count)).split("{text}")
    prompt = F.concat(F.lit(head), F.col("text"), F.lit(tail))
    return chunks.select(*keys, prompt.alias("prompt"))


def complete(
    prompts: DataFrame,
    model: Callable[[list[str]], list[str]],
    batch_size: int = 16,
    given: str | None = None,
) -> DataFrame:
    """(…, raw, error): a prompts table through ``model``, a function of a list of prompts.

    A batch the model fails on, or gives another number of answers to, is retried prompt by
    prompt; a prompt it fails on becomes a row with an error and no text, so one bad row never
    fails the job. Rows that hold an answer in the column ``given`` are not asked again.
    """
    keys = [field for field in prompts.schema.fields if field.name != "prompt"]
    names = [field.name for field in keys]

    def attempt(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = list(model(texts))
            if len(answers) != len(texts):
                raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
            return [(answer, None) for answer in answers]
        except Exception as problem:  # noqa: BLE001 - the model is the user's code
            if len(texts) > 1:
                return [attempt([text])[0] for text in texts]
            return [(None, str(problem))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prompts = frame["prompt"].tolist()
            known = [None] * len(prompts) if given is None else frame[given].tolist()
            answers: list[tuple[str | None, str | None]] = []
            for start in range(0, len(prompts), batch_size):
                part = known[start : start + batch_size]
                texts = [p for p, text in zip(prompts[start : start + batch_size], part) if text is None]
                asked = iter(attempt(texts) if texts else [])
                answers += [next(asked) if text is None else (text, None) for text in part]
            yield frame[names].assign(
                raw=[raw for raw, _ in answers], error=[error for _, error in answers]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
    return prompts.mapInPandas(run, f"{fields}, raw string, error string")


def parse_questions(raw: Column, limit: int = 0) -> Column:
    """ARRAY<STRING>: one question per line, without bullets and numbering."""
    lines = F.transform(
        split_lines(raw), lambda line: strip(F.regexp_replace(strip(line), LIST_MARKER, ""))
    )
    questions = F.filter(lines, lambda line: line != "")
    return F.slice(questions, 1, limit) if limit else questions


def chunk_questions(completions: DataFrame, limit: int = 0) -> DataFrame:
    """Completions to (keys, questions); failed and empty ones have no row."""
    parsed = completions.filter(F.col("raw").isNotNull()).withColumn(
        "questions", parse_questions(F.col("raw"), limit)
    )
    return nonempty_questions(parsed.drop("raw", "error"))


def nonempty_questions(questions: DataFrame) -> DataFrame:
    return questions.filter(F.size("questions") > 0)
