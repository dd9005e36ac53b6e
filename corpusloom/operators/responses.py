"""Model responses kept as tables: a log row per request, its body as JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import WS_SET, strip

EMBEDDING_BODY = "data array<struct<index: int, embedding: array<double>>>, error string"
COMPLETION_BODY = (
    "choices array<struct<message: struct<content: string>, finish_reason: string>>, "
    "usage struct<completion_tokens_details: struct<reasoning_tokens: bigint>>, error string"
)
# Words in a rejection that mean the batch was too large.
TOO_LARGE_HINTS = ("too many", "batch", "exceed", "limit", "too large")
THINK_BLOCK = rf"(?is)<think>.*?</think>[{WS_SET}]*"


def parse_embedding_response(log: DataFrame) -> DataFrame:
    """(request_id, status, vectors): vectors back in input order, or what went wrong."""
    body = log.withColumn("_body", F.from_json("body", EMBEDDING_BODY))
    # A row without an index counts as the first; rows of one index keep their order.
    rows = F.transform(
        F.coalesce("_body.data", F.array()),
        lambda row, at: F.struct(
            F.coalesce(row["index"], F.lit(0)).alias("index"),
            at.alias("at"),
            row["embedding"].alias("embedding"),
        ),
    )
    counted = body.withColumn("_rows", F.sort_array(rows))
    complete = F.size("_rows") == F.col("n_inputs")
    status = F.when(complete, F.lit("ok")).otherwise(
        F.format_string("Asked for %d embeddings, got %d.", F.col("n_inputs"), F.size("_rows"))
    )
    return counted.select(
        "request_id",
        status.alias("status"),
        F.when(complete, F.col("_rows.embedding")).alias("vectors"),
    )


def parse_completion(log: DataFrame) -> DataFrame:
    """(request_id, content, error): the first choice's text without its scratchpad."""
    body = log.withColumn("_body", F.from_json("body", COMPLETION_BODY))
    choice = F.try_element_at(F.col("_body.choices"), F.lit(1))
    content = F.coalesce(choice["message"]["content"], F.lit(""))
    reason = choice["finish_reason"]
    tokens = F.coalesce(
        F.col("_body.usage.completion_tokens_details.reasoning_tokens"), F.lit(0)
    )
    no_choice = F.coalesce(F.size("_body.choices"), F.lit(0)) < 1
    error = F.when(
        no_choice, F.concat(F.lit("No choices in response: "), F.substring("body", 1, 300))
    ).when(
        strip(content) == "",
        F.concat(
            F.lit("Empty reply (finish_reason="),
            F.coalesce(F.concat(F.lit("'"), reason, F.lit("'")), F.lit("None")),
            F.lit(", reasoning_tokens="),
            tokens.cast("string"),
            F.lit("). Raise max_tokens: reasoning is billed against the same budget."),
        ),
    )
    answer = strip(F.regexp_replace(content, THINK_BLOCK, ""))
    return body.select(
        "request_id",
        F.when(error.isNull(), answer).alias("content"),
        error.alias("error"),
    )


def response_outcome(status: Column, body: Column, n_inputs: Column) -> Column:
    """ok | fail | retry | split: what a request log row calls for."""
    has_error = F.coalesce(F.get_json_object(body, "$.error"), F.lit("")) != ""
    hinted = F.lit(False)
    for hint in TOO_LARGE_HINTS:
        hinted = hinted | F.contains(F.lower(body), F.lit(hint))
    return (
        F.when(status == 200, F.when(has_error, "fail").otherwise("ok"))
        .when((status == 429) | (status >= 500), "retry")
        .when((status == 400) & (n_inputs > 1) & hinted, "split")
        .otherwise("fail")
    )


def classify_responses(log: DataFrame) -> DataFrame:
    return log.withColumn(
        "outcome", response_outcome(F.col("status"), F.col("body"), F.col("n_inputs"))
    )


def outcome_counts(log: DataFrame) -> DataFrame:
    return classify_responses(log).groupBy("outcome").agg(
        F.count("*").alias("requests"), F.sum("n_inputs").alias("inputs")
    )


def _halves(items: Column) -> Column:
    middle = F.floor(F.size(items) / 2).cast("int")
    return F.array(F.slice(items, F.lit(1), middle), F.slice(items, middle + 1, F.size(items)))


def halve_batches(batches: DataFrame, key: str = "request_id", items: str = "items") -> DataFrame:
    """Each rejected batch as its two halves, in order; single items stay whole."""
    halves = F.when(F.size(items) > 1, _halves(F.col(items))).otherwise(F.array(F.col(items)))
    return batches.select(key, F.posexplode(halves).alias("half", items))


def split_until_accepted(
    batches: DataFrame,
    accepted: Callable[[Column], Column],
    key: str = "request_id",
    items: str = "items",
) -> DataFrame:
    """(key, part, items): batches halved until the service takes every part, or it is a single item.

    ``accepted`` tells for an array of items whether it would be taken. Parts keep the order of the items.
    A batch of n items is settled after at most log2(n) + 1 rounds, which all happen in its row; an empty batch
    is one part, a null one has none.
    """

    def settle(parts: Column, _: Column) -> Column:
        whole = lambda part: accepted(part) | (F.size(part) <= 1)
        return F.flatten(
            F.transform(parts, lambda p: F.when(whole(p), F.array(p)).otherwise(_halves(p)))
        )

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(items), F.lit(1)))).cast("int"))
    parts = F.when(F.col(items).isNotNull(), F.aggregate(rounds, F.array(F.col(items)), settle))
    found = batches.select(key, F.posexplode_outer(parts).alias("part", items))
    return found.filter(F.col("part").isNotNull())
