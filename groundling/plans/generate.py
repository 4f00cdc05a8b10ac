"""The seam where text is generated: any callable on batches of prompts.

The engine ships only a deterministic fake. A generator runs in executors'
Python workers, one call a batch (more where one fails); what it returns is materialised before any
later stage reads it, since a model may answer differently when asked again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from groundling.functions import text as tx
from groundling.operators import rules
from groundling.operators.planning import looks_truncated
from groundling.plans import prompts
from groundling.session import materialise

#: (kind, prompts) -> texts
Generator = Callable[[str, list[str]], list[str]]


def fake_generator(kind: str, prompts: list[str]) -> list[str]:
    """Texts that depend on kind and prompt alone: claims for ``extract``, an article for ``write``."""
    out = []
    for prompt in prompts:
        tail = prompt.rpartition("SOURCE\n")[2] if kind == "extract" else prompt.rpartition("CLAIMS\n")[2]
        if kind == "extract":
            quote = " ".join(tail.split(None, 12)[:12])
            out.append(f'CLAIM: {quote}\nSOURCE_QUOTE: "{quote}"\nTYPE: result\nSTRENGTH: demonstrated\n---' if quote else "NONE")
        else:
            facts = [line.removeprefix("CLAIM: ") for line in tail.splitlines() if line.startswith("CLAIM: ")]
            mark = hashlib.sha256(f"{kind}\0{prompt}".encode()).hexdigest()[:8]
            body = "\n\n".join(f"## Finding {k + 1}\n\n{fact}." for k, fact in enumerate(facts)) or "## Nothing\n\nNothing was found."
            out.append(f'# Report {mark}\n\n<aside class="post-lead"></aside>\n\n> **Executive Summary**\n> - {len(facts)} facts.\n\n{body}')
    return out


class Cancelled(Exception):
    """A generator was stopped by who asked it: its rows fail, and no other generator is asked for them."""


def along_chain(kind: str, prompts: list[str], generators: list[Generator], cursor: int = 0) -> tuple[list[tuple[str, str, int]], int]:
    """((text, error, generator) of each prompt, where the chain stands afterwards), asking from ``cursor`` on.

    A call that fails is halved until the prompt it fails on is alone, so what
    else it held keeps its answers. That prompt and all after it then go to the
    next generator, and none goes back. The last generator is never left: its
    failures are errors of their prompts. :class:`Cancelled` and
    ``TimeoutError`` fail all prompts of their call and leave the chain where it
    stands.
    """
    out, todo = [("", "", cursor)] * len(prompts), [(0, len(prompts))] if prompts else []
    while todo:
        low, high = todo.pop()
        try:
            texts = generators[cursor](kind, prompts[low:high])
            if len(texts) != high - low:
                raise ValueError(f"{len(texts)} answers to {high - low} prompts")
            out[low:high] = [(text or "", "", cursor) for text in texts]
        except Exception as failure:  # noqa: BLE001  a backend may fail in any way; the row says how
            stopped = isinstance(failure, (Cancelled, TimeoutError))
            if stopped or (high - low == 1 and cursor == len(generators) - 1):
                out[low:high] = [("", f"{type(failure).__name__}: {failure}", cursor)] * (high - low)
            elif high - low > 1:
                todo += [((low + high) // 2, high), (low, (low + high) // 2)]
            else:
                cursor, todo = cursor + 1, [(low, len(prompts))]  # all before it is answered, all after it is not
    return out, cursor


def with_fallback(asked: DataFrame, key: str, kind: str, generators: list[Generator], carry: Sequence[str] = ()) -> DataFrame:
    """(key, text, error, generator) of ``asked`` (key, prompt) in one pass, see :func:`along_chain`; a partition's chain stands across its batches.

    A null prompt is an empty one. A task that runs again starts its chain anew.
    Columns of ``asked`` named by ``carry`` follow, so no join has to bring them back.
    """
    if not generators:
        raise ValueError("no generator is given")

    kept = asked.select(key, F.coalesce(F.col("prompt"), F.lit("")).alias("prompt"), *carry)
    schema = StructType([kept.schema[key], StructField("text", StringType()), StructField("error", StringType()), StructField("generator", IntegerType()), *kept.schema.fields[2:]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cursor = 0
        for batch in batches:
            rows, cursor = along_chain(kind, batch.column(1).to_pylist(), generators, cursor)
            texts, errors, which = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string()), pa.array(which, pa.int32()), *batch.columns[2:]], names)

    return kept.mapInArrow(run, schema)


def generate(asked: DataFrame, key: str, kind: str, generator: Generator) -> DataFrame:
    """(key, text, error) of ``asked`` (key, prompt); a prompt that the generator fails on has an error and no text."""
    return with_fallback(asked, key, kind, [generator]).drop("generator")


def continue_until_closed(texts: DataFrame, key: str, generator: Generator, repair: Callable[[Column], Column], rounds: int = 3) -> DataFrame:
    """(key, text): texts that stop within a sentence are carried on, ``rounds`` times at most; what is still open ends after its last sentence.

    Only open texts are asked about. A generator that fails, or has nothing to
    add, ends a text's rounds.
    """
    done, left, over = None, texts.select(key, "text"), None
    for _ in range(rounds):
        is_open = looks_truncated(F.lit(False), F.col("text"))
        closed, left = left.where(~is_open), left.where(is_open)
        done = closed if done is None else done.unionByName(closed)
        if left.isEmpty():
            break
        answers = generate(left.select(key, prompts.continue_prompt(F.col("text")).alias("prompt")), key, "continue", generator)
        said = materialise(answers.select(key, F.when(F.col("error") == "", repair(tx.text("text"))).otherwise("").alias("more")), "continued")
        joined = left.join(said, key)
        stuck = joined.where(tx.strip(F.col("more")) == "").select(key, "text")
        over = stuck if over is None else over.unionByName(stuck)
        grown = F.concat(tx.right_trim(F.col("text")), F.lit(" "), F.regexp_replace("more", r"\A[ \t\r\n]+", ""))
        left = materialise(joined.where(tx.strip(F.col("more")) != "").select(key, grown.alias("text")), "grown")
    rest = left if over is None else left.unionByName(over)
    whole = tx.trim_sentence(F.col("text"))
    cut = F.when(looks_truncated(F.lit(False), F.col("text")) & (whole != ""), whole).otherwise(F.col("text"))
    ended = rest.select(key, cut.alias("text"))
    return ended if done is None else done.unionByName(ended)


def write_until_valid(wanted: DataFrame, key: str, generator: Generator, repair: Callable[[Column], Column], retries: int = 2, rounds: int = 3, facts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, text, house, errors): articles for prompts (key, prompt), rewritten while they break a rule, ``retries`` times at most; only failing rows are asked again.

    Rules are the house rules and, where given, ``facts``: from (key, text) to
    (key, facts, ...), an array of further errors; all its columns are returned
    as they were found for the text that stays, so no text is checked again.
    """
    done, left = None, wanted
    for turn in range(retries + 1):
        first = materialise(generate(left, key, "write", generator).select(key, repair(tx.text("text")).alias("text")), "drafted")
        texts = materialise(continue_until_closed(first, key, generator, repair, rounds), "closed")
        checked = texts.withColumn("house", rules.house_errors(F.col("text")))
        if facts is None:
            checked = checked.withColumn("errors", F.col("house"))
        else:
            none = F.array().cast("array<string>")
            checked = checked.join(facts(texts), key, "left").withColumn("errors", F.concat("house", F.coalesce("facts", none)))
        tried = materialise(checked, "written")
        keep = tried if turn == retries else tried.where(F.size("errors") == 0)
        done = keep if done is None else done.unionByName(keep)
        again = tried.where(F.size("errors") > 0)
        if turn == retries or again.isEmpty():
            break
        left = wanted.join(again.select(key, F.array_join("errors", "\n- ").alias("why")), key).select(key, F.concat("prompt", F.lit(prompts.FIX_HEAD), "why").alias("prompt"))
    return done
