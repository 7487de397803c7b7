"""Names of flows and components by a pluggable provider; failures are data."""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmap.config import NAME_ALIASES, NAME_KEYS

SYSTEM_PROMPT = "You name technologies. From weighted keywords, answer with one JSON object with the keys " + ", ".join(NAME_KEYS) + ": a Korean and an English name, and one sentence for each of the others."


class NameProvider(Protocol):
    model: str

    def answer(self, system: str, user: str) -> str: ...


class OfflineNames:
    """The default without a network: the leading terms, in title case."""

    model = "offline"

    def answer(self, system: str, user: str) -> str:
        words = [w.strip() for w in user.partition(":")[2].split("\n")[0].split(",") if w.strip()]
        name = " ".join(words[:3]).title()
        return json.dumps({"tech_name_ko": name, "tech_name_en": name, "purpose": "", "method": ", ".join(words[:5]), "novelty": "", "rationale": "leading terms"})


class ChatNames:
    """A provider over any chat client: `complete(model, messages, temperature, timeout, response_format)` gives the answer's text.

    It asks for one JSON object; a client that knows no response_format is asked without, once and for all.
    """

    def __init__(self, complete: Callable[..., str | None], model: str, temperature: float = 0.35, timeout: float = 60.0):
        self.complete, self.model, self.temperature, self.timeout, self.json_mode = complete, model, temperature, timeout, True

    def answer(self, system: str, user: str) -> str:
        said = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": self.temperature, "timeout": self.timeout}
        if self.json_mode:
            try:
                return self.complete(**said, response_format={"type": "json_object"}) or "{}"
            except TypeError as e:
                if "response_format" not in str(e):
                    raise
                self.json_mode = False
        return self.complete(**said) or "{}"


def read_answer(text: str) -> dict:
    """The whole answer as a JSON object; else its first flat JSON object, fences aside; else its `key: value` lines."""
    plain = text.replace("```json", "").replace("```JSON", "").replace("```", "")
    start = plain.find("{")
    end = plain.find("}", start)
    for part in (text, plain[start : end + 1] if 0 <= start < end else ""):
        try:
            found = json.loads(part)
            if isinstance(found, dict):
                return found
        except ValueError:
            pass
    pairs = (re.fullmatch(r"\s*(\w+)\s*:\s*(.+?)\s*", line, re.ASCII | re.DOTALL) for line in plain.split("\n"))
    return {m[1]: m[2] for m in pairs if m}


def six_fields(answer: dict) -> dict[str, str]:
    """The six name fields: own key, then aliases in fixed order; anything but text as JSON, null as empty."""
    own = {k.strip(): v for k, v in answer.items()}
    out = {}
    for key in NAME_KEYS:
        value = next((own[k] for k in (key, *NAME_ALIASES[key]) if own.get(k) is not None), "")
        out[key] = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return out


def within(seconds: float, call, *args):
    """What call(*args) returns; TimeoutError after `seconds`, the call left to itself."""
    out: list = []

    def run():
        try:
            out.append((call(*args), None))
        except Exception as e:
            out.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not out:
        raise TimeoutError(f"no answer within {seconds} s")
    value, error = out[0]
    if error:
        raise error
    return value


def ask(provider: NameProvider, user: str, tries: int = 4, base: float = 1.5, sleep=time.sleep, timeout: float = 60.0) -> str:
    """The provider's answer, tried again after growing, jittered waits; the last failure or timeout is raised."""
    for k in range(tries):
        try:
            return within(timeout, provider.answer, SYSTEM_PROMPT, user)
        except Exception:
            if k == tries - 1:
                raise
            sleep(base**k + random.random() / 2)
    raise AssertionError


NAMES_SCHEMA = "id int, tech_name_ko string, tech_name_en string, purpose string, method string, novelty string, rationale string, raw_text string, model string, status string"


def name_groups(groups: DataFrame, keywords: DataFrame, provider: NameProvider | None = None, workers: int = 4, top: int = 60) -> DataFrame:
    """One row of NAMES_SCHEMA for each row (id) of `groups`, from keywords (id, term, rank).

    Rows come in the order of id. `workers` partitions bound the calls made at once. A group without terms has status no_terms, a failed call
    `error: ...`; neither fails the job.
    """
    provider = provider or OfflineNames()
    terms = keywords.where(F.col("rank") <= top).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s.term).alias("terms"))
    rows = groups.select(F.col("id").cast("int").alias("id")).join(terms.withColumn("id", F.col("id").cast("int")), "id", "left").repartition(workers, "id")

    def name(batches):
        for batch in batches:
            out = []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, status, fields = "", "ok", {}
                if not words:
                    status = "no_terms"
                else:
                    try:
                        raw = ask(provider, "Keywords: " + ", ".join(words))
                        fields = read_answer(raw)
                    except Exception as e:
                        status = f"error: {e}"
                out.append({"id": key, **six_fields(fields), "raw_text": raw, "model": provider.model, "status": status})
            kinds = pa.schema([("id", pa.int32()), *((c, pa.string()) for c in (*NAME_KEYS, "raw_text", "model", "status"))])
            yield pa.RecordBatch.from_pylist(out, kinds)

    return rows.mapInArrow(name, NAMES_SCHEMA).orderBy("id")
