"""Extraction as table functions for SQL: text in, rows out, failures as rows.

    spark.udtf.register("instances_of", instance_function(complete))
    SELECT d.id, i.* FROM prompts d, LATERAL instances_of(d.prompt) i
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql.functions import udtf

INSTANCE = "pos int, uri_suffix string, type string, summary string, paragraph_ref string, evidence_text string, error string"
ENTITY = "pos int, text string, type string, start int, error string"
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$")


def read_instances(answer: str | None) -> Iterator[tuple]:
    """Rows of INSTANCE of one answer: those with a suffix and a type, in order; an answer that is no JSON object, or whose instances are no list, is one row with its error."""
    try:
        got = json.loads(_FENCE.sub("", (answer or "").strip()))
        found = got.get("instances", [])
        if not isinstance(found, list):
            raise ValueError("instances are no list")
    except (ValueError, AttributeError) as e:
        yield (None, None, None, None, None, None, f"no answer: {e}"[:200])
        return
    for pos, i in enumerate(found):
        if isinstance(i, dict) and i.get("uri_suffix") is not None and i.get("type") is not None:
            yield (pos, *(None if (v := i.get(k)) is None else str(v) for k in ("uri_suffix", "type", "summary", "paragraph_ref", "evidence_text")), None)


def instance_function(complete: Callable[[str], str], retries: int = 3, pause: float = 4.0):
    """A table function from a prompt to the instances in a model's answer.

    A call that fails is tried again; the last failure, and an answer that is
    none, is a row with its error and nothing else. A null prompt gives no rows.
    """

    class Instances:
        def eval(self, prompt: str):
            if prompt is None:
                return
            for turn in range(1, retries + 1):
                try:
                    answer = complete(prompt)
                    break
                except Exception as e:  # whatever a client raises is a failed attempt
                    if turn == retries:
                        yield (None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200])
                        return
                    time.sleep(pause * turn)
            yield from read_instances(answer)

    return udtf(Instances, returnType=INSTANCE)


def entity_function(load: Callable[[], Callable[[str], list[tuple[str, str, int]]]]):
    """A table function from a text to its entities. ``load`` makes a finder, text to [(entity, type, start)], once in each task; a finder that fails on a text gives a row with the error. A null text gives no rows."""

    class Entities:
        def __init__(self):
            self.find = load()

        def eval(self, text: str):
            if text is None:
                return
            try:
                found = list(self.find(text))
            except Exception as e:  # one text's failure is its row
                yield (None, None, None, None, f"{type(e).__name__}: {e}"[:200])
                return
            for pos, (entity, kind, start) in enumerate(found):
                yield (pos, entity, kind, start, None)

    return udtf(Entities, returnType=ENTITY)
