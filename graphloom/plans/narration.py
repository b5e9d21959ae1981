"""Words about paths: lines, prompts, and narrators that can be plugged in."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.texts import path_line

TASK = "Explain what these paths show about the question. Name the strongest one with its confidence, and add nothing that is not in them."
# The marks of two chat formats; a model is told by its file's name.
CHAT = {"phi": "<|user|>\n{0}\n<|end|>\n<|assistant|>\n", "": "<|im_start|>user\n{0}\n<|im_end|>\n<|im_start|>assistant\n"}


def path_lines(paths: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, lines): each query's first paths(query_id, rank, labels, conductivity), a line each."""
    rows = paths.where(F.col("rank") <= k).select("query_id", "rank", path_line(F.col("rank"), F.col("conductivity"), F.col("labels")).alias("line"))
    held = F.array_sort(F.collect_list(F.struct("rank", "line")))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias("lines"))


def path_records(paths: DataFrame) -> DataFrame:
    """Paths as they are handed out: conductivity to six places, hops to four."""
    return paths.select("query_id", "rank", F.col("labels").alias("path"), F.round("conductivity", 6).alias("conductivity"), F.transform("hop_scores", lambda x: F.round(x, 4)).alias("hop_scores"), "length")


def prompts(queries: DataFrame, lines: DataFrame, model: str = "") -> DataFrame:
    """(query_id, prompt) of queries(query_id, query)."""
    form = CHAT["phi" if "phi" in model.lower() else ""]
    head, tail = form.split("{0}")
    text = F.concat(F.lit(head), F.lit("Question: "), "query", F.lit("\n\nReasoning paths:\n"), "lines", F.lit(f"\n\n{TASK}"), F.lit(tail))
    return queries.join(lines, "query_id").select("query_id", text.alias("prompt"))


def narrate(prompt: str, generate: Callable[..., Iterator[str]] | None = None, max_tokens: int = 400, temperature: float = 0.2) -> Iterator[str]:
    """The answer in pieces, as a generator gives them; without one the paths' own lines."""
    if generate is not None:
        yield from generate(prompt, max_tokens=max_tokens, temperature=temperature)
    else:
        yield from (line + "\n" for line in prompt.split("\n") if line.startswith("Path "))


def load_narrator(model: str | None, context: int = 4096) -> Callable[..., Iterator[str]] | None:
    """A generator over a local model file, if one is named and its library can load it; else None, and narrate() gives the paths' lines."""
    if not model:
        return None
    try:
        from llama_cpp import Llama

        loaded = Llama(model_path=os.path.expanduser(model), n_ctx=context, verbose=False)
    except Exception as e:  # not installed, or no such model
        print(f"{model} cannot be loaded ({type(e).__name__}); paths are told as they are", file=sys.stderr)
        return None

    def generate(prompt: str, max_tokens: int, temperature: float) -> Iterator[str]:
        for piece in loaded(prompt, max_tokens=max_tokens, temperature=temperature, stream=True):
            yield piece["choices"][0]["text"]

    return generate


def one_prompt(question: str, records: list[dict], model: str = "") -> str:
    """The prompt for one question's path records, as prompts() makes them for many."""
    lines = "\n".join(f"Path {r['rank']} (confidence {r['conductivity']:.2f}, {r['length'] - 1} hop{'' if r['length'] == 2 else 's'}): {' → '.join(map(str, r['path']))}" for r in records)
    return CHAT["phi" if "phi" in model.lower() else ""].format(f"Question: {question}\n\nReasoning paths:\n{lines}\n\n{TASK}")
