"""Model requests: model classes, parameters, messages and token usage."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivane.operators.ordered import numbered

#: Fixed value: beginnings of the names of reasoning models.
REASONING = ("gpt-5", "o1", "o3")


def is_reasoning(model: Column) -> Column:
    return F.coalesce(model.rlike("^(" + "|".join(REASONING) + ")"), F.lit(False))


def is_reasoning_name(model: str) -> bool:
    return model.startswith(REASONING)


def chat_parameters(model: Column, limit: Column, effort: Column, temperature: Column) -> Column:
    """Parameters of a chat request as a struct; those that are not sent are null.

    Reasoning models take max_completion_tokens and an effort, and a temperature
    only at effort ``none``; others take max_tokens and a temperature.
    """
    r = is_reasoning(model)
    return F.struct(
        model.alias("model"), F.when(~r, limit).alias("max_tokens"), F.when(r, limit).alias("max_completion_tokens"), F.when(r, effort).alias("reasoning_effort"),
        F.when(~r | (effort == "none"), temperature).alias("temperature"),
    )


def response_parameters(model: str, limit: int, temperature: float, effort: str | None = None, *, store: bool = False, instructions: str | None = None, previous: str | None = None) -> dict[str, Any]:
    """Parameters of a stateful response request."""
    out: dict[str, Any] = {"model": model, "store": store, "max_output_tokens": limit}
    if instructions is not None:
        out["instructions"] = instructions
    if previous is not None:
        out["previous_response_id"] = previous
    if is_reasoning_name(model):
        if effort is not None:
            out["reasoning"] = {"effort": effort}
        if effort == "none":
            out["temperature"] = temperature
    else:
        out["temperature"] = temperature
    return out


def token_limit(options: dict[str, Any], default: int) -> int:
    """The first of the limit's names that is set."""
    for name in ("max_output_tokens", "max_completion_tokens", "max_tokens"):
        if options.get(name) is not None:
            return int(options[name])
    return default


def normal_usage(usage: Column) -> Column:
    """A provider's usage map as a struct of input, output and total tokens."""
    first = lambda *names: F.coalesce(*(usage[n] for n in names), F.lit(0))
    i, o = first("input_tokens", "prompt_tokens"), first("output_tokens", "completion_tokens")
    return F.struct(i.alias("input_tokens"), o.alias("output_tokens"), F.coalesce(usage["total_tokens"], i + o).alias("total_tokens"))


def system_instructions(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """By conversation: the last system text as instructions (null without one), and the number of other messages."""
    system = F.col("role") == "system"
    return messages.groupBy(conv).agg(F.max_by(F.when(system, F.col("text")), F.when(system, F.col(turn))).alias("instructions"), F.count_if(~system).alias("n_inputs"))


def labelled_images(images: DataFrame, request: str, position: str, ties: list[str] | None = None) -> DataFrame:
    """Content items of a request's images in order, labelled ``Image n:`` where there are several."""
    n = numbered(images, request, position, ties=ties, name="_n", total="_of")
    return n.withColumn("label", F.when(F.col("_of") > 1, F.concat(F.lit("Image "), (F.col("_n") + 1).cast("string"), F.lit(":")))).drop("_n", "_of")
