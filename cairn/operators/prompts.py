"""Model operators: batches mapped by functions or by classes built once a worker, prompts, judgments, SQL functions.

What a function given to these operators must keep to: it reads nothing but its arguments and what its class built in
``__init__``; it gives one result for each row and in their order (``map_batches`` may give any rows); it keeps no state
from one batch to the next that its results depend on, since tasks are repeated and batches cut anywhere; and it opens
clients and models in its worker, never in the driver.
"""

from __future__ import annotations

import concurrent.futures
import json
import threading
import time
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BUILT: dict[str, Any] = {}


def once_a_worker(build: Callable[[], Any], name: str) -> Any:
    """What ``build`` makes, kept by the worker's process under ``name``: later tasks of the same worker find it."""
    if name not in _BUILT:
        _BUILT[name] = build()
    return _BUILT[name]


_count = iter(range(1 << 62))


def _name(of: object) -> str:
    """A name for what one call of an operator builds; made on the driver, so that all its tasks share it."""
    return f"{getattr(of, '__qualname__', type(of).__name__)}-{time.time_ns()}-{next(_count)}"


def map_batches(rows: DataFrame, work: Callable | type, schema: str, batch_size: int = 1000) -> DataFrame:
    """Rows mapped by ``work(pa.RecordBatch) -> pa.RecordBatch`` in batches of at most ``batch_size`` rows.

    ``work`` is a function, or a class whose instances are such functions: then it is built once a worker.
    """
    name = _name(work)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = once_a_worker(work, name) if isinstance(work, type) else work
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                yield call(batch.slice(at, batch_size))

    return rows.mapInArrow(run, schema)


def register_function(spark: SparkSession, name: str, work: Callable | type, returns: str) -> None:
    """``work(*values)``, or an instance of it that each worker builds once, as a function of SQL; Arrow batches in and out."""
    built = _name(work)

    def run(*columns: pd.Series) -> pd.Series:
        call = once_a_worker(work, built) if isinstance(work, type) else work
        values = [None if v is None else v for v in (call(*row) for row in zip(*columns, strict=True))]
        return pd.Series(values, dtype="object")

    spark.udf.register(name, F.pandas_udf(run, returns))


class Prompter(Protocol):
    """Answers prompts, one for one; ``system`` is the instruction that stands before each.

    A prompter that also has ``one(prompt, system)``, safe to call from several threads, can be asked concurrently.
    """

    def answer(self, prompts: list[str], system: str | None = None) -> list[str]: ...


class Late(TimeoutError):
    """No answer within the deadline."""


class Pool:
    """At most ``most`` requests at once from one worker; kept from batch to batch.

    Requests are taken from their iterator as places fall free, so no more than ``most`` of them wait in memory, and
    results come as they are ready, each with the key of its request. A request that is not answered ``deadline``
    seconds after it began is given up as ``Late``: its thread cannot be stopped, so it keeps its place until it ends,
    and the service never sees more than ``most`` at once. Errors are results, which the caller may ask again.
    """

    def __init__(self, one: Callable[[str, str | None], str], most: int, deadline: float | None = None):
        if most < 1:
            raise ValueError("a pool needs a place")
        self.one, self.most, self.deadline = one, most, deadline
        self.threads = concurrent.futures.ThreadPoolExecutor(most, thread_name_prefix="prompt")
        self.places = threading.Semaphore(most)

    def _call(self, text: str, system: str | None, began: list[float]) -> str:
        began.append(time.monotonic())
        try:
            return self.one(text, system)
        finally:
            self.places.release()

    def ask(self, requests: Iterable[tuple[Hashable, str]], system: str | None = None) -> Iterator[tuple[Hashable, str | Exception]]:
        """(key, answer or error) of each request, in the order in which they end."""
        waiting = iter(requests)
        running: dict[concurrent.futures.Future, tuple[Hashable, list[float]]] = {}
        more = True
        while more or running:
            while more and self.places.acquire(blocking=not running):
                request = next(waiting, None)
                if request is None:
                    more = False
                    self.places.release()
                    break
                began: list[float] = []
                running[self.threads.submit(self._call, request[1], system, began)] = (request[0], began)
            if not running:
                break
            done, _ = concurrent.futures.wait(running, timeout=self._next_deadline(running), return_when=concurrent.futures.FIRST_COMPLETED)
            for future in done:
                key, _ = running.pop(future)
                error = future.exception()
                if error is not None and not isinstance(error, Exception):
                    raise error
                yield key, error if error is not None else future.result()
            if self.deadline is not None and not done:
                now = time.monotonic()
                for future, (key, began) in list(running.items()):
                    if began and now - began[0] >= self.deadline and not future.done():
                        del running[future]
                        yield key, Late(f"no answer within {self.deadline:g} s")

    def _next_deadline(self, running: dict) -> float | None:
        if self.deadline is None:
            return None
        ends = [began[0] + self.deadline for _, began in running.values() if began]
        return max(0.001, min(ends) - time.monotonic()) if ends else 0.01

    def __reduce__(self):
        raise TypeError("a pool belongs to one worker")


def messages(*parts: Column | str) -> Column:
    """Columns and texts joined to one prompt; null where a column is."""
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def with_image(text: Column | str, content: Column, mime_type: str = "image/png") -> Column:
    """A prompt of a text and an image's bytes, as a JSON list of parts that ``HttpPrompter`` sends as such."""
    url = F.concat(F.lit(f"data:{mime_type};base64,"), F.base64(content))
    said = F.to_json(F.struct(F.lit("text").alias("type"), (text if isinstance(text, Column) else F.lit(text)).alias("text")))
    shown = F.to_json(F.struct(F.lit("image_url").alias("type"), F.struct(url.alias("url")).alias("image_url")))
    return F.concat(F.lit("["), said, F.lit(","), shown, F.lit("]"))


class Refused(ValueError):
    """An answer is not of the wanted form."""


def _parser(schema: T.StructType) -> Callable[[str], dict]:
    """Answers as objects with exactly the fields of a schema, of its types."""
    kinds = {T.StringType: str, T.BooleanType: bool, T.LongType: int, T.IntegerType: int, T.DoubleType: (int, float)}

    def parse(answer: str) -> dict:
        try:
            value = json.loads(answer)
        except (TypeError, ValueError) as e:
            raise Refused("the answer is not JSON") from e
        if not isinstance(value, dict) or set(value) != set(schema.names):
            raise Refused(f"the answer has not the fields {', '.join(schema.names)}")
        for f in schema.fields:
            wanted, v = kinds.get(type(f.dataType)), value[f.name]
            odd = wanted is not bool and isinstance(v, bool)
            if not (v is None and f.nullable) and wanted and (odd or not isinstance(v, wanted)):
                raise Refused(f"{f.name} is not {f.dataType.simpleString()}")
            if wanted == (int, float) and v is not None:
                value[f.name] = float(v)
        return value

    return parse


def prompt(
    rows: DataFrame, build: Callable[[], Prompter], key: str, text: str | Column, validate: Callable[[str], Any] | None = None, stricter: str = "", *,
    system: str | None = None, returns: str | None = None, on_error: str = "row", batch_size: int = 32, parts: int | None = None,
    concurrency: int = 1, deadline: float | None = None,
) -> DataFrame:
    """(key, response, status, error) of each row; a null prompt is skipped.

    ``text`` is a column or an expression such as ``messages``. ``returns`` is a schema: answers must be JSON objects of
    it, and the response is a struct. An answer that ``validate`` or the schema refuses is asked for once more with
    ``stricter`` before the prompt (the prompt again where it is empty); what is refused twice is a row with an error,
    or, with ``on_error="raise"``, an error of the query that names the row. Rows are bound by key, never by order. The
    prompter is built once a worker; ``parts`` bounds how many tasks ask at once.

    With ``concurrency`` a worker has that many requests of its batch under way at once (``Pool``), each for at most
    ``deadline`` seconds; the prompter must then have ``one``. A request that fails or is late is asked once more, as
    refused answers are, and is then a row of status ``failed`` or ``timeout``: no row is lost or asked for a third time.
    """
    if concurrency < 1:
        raise ValueError("concurrency is one or more")
    if on_error not in ("row", "raise"):
        raise ValueError("on_error is row or raise")
    kind, name = rows.schema[key].dataType.simpleString(), _name(build)
    shape = T.StructType.fromDDL(returns) if returns else None
    parse = _parser(shape) if shape else (lambda answer: answer)
    accept = lambda answer: validate(parse(answer)) if validate else parse(answer)

    def answers(requests: list[tuple[int, str]]) -> Iterable[tuple[int, str | Exception]]:
        prompter = once_a_worker(build, name)
        if concurrency > 1 or deadline is not None:
            pool = once_a_worker(lambda: Pool(prompter.one, concurrency, deadline), f"{name}-pool")
            return pool.ask(requests, system)
        extra = {"system": system} if system else {}
        return zip((i for i, _ in requests), prompter.answer([p for _, p in requests], **extra), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                batch = whole.slice(at, batch_size)
                keys, asked = batch.column(0), batch.column(1).to_pylist()
                out: list[tuple] = [(None, "skipped", None)] * len(asked)
                todo = [i for i, p in enumerate(asked) if p is not None]
                for lead in ("", stricter):
                    if not todo:
                        break
                    again = []
                    for i, answer in answers([(i, lead + asked[i]) for i in todo]):
                        try:
                            if isinstance(answer, Exception):
                                raise answer
                            good = accept(answer)
                            out[i] = (json.dumps(good) if shape else good, "success", None)
                            continue
                        except Late as e:
                            out[i] = (None, "timeout", str(e))
                        except ValueError as e:
                            out[i] = (None, "invalid_response", str(e))
                        except Exception as e:  # the service's own errors, of a pool alone
                            out[i] = (None, "failed", f"{type(e).__name__}: {e}")
                        again.append(i)
                    todo = sorted(again)
                if todo and on_error == "raise":
                    raise Refused(f"{key} {keys[todo[0]].as_py()}: {out[todo[0]][2]}")
                response, status, error = zip(*out, strict=True) if out else ((), (), ())
                columns = [keys, *(pa.array(c, pa.string()) for c in (response, status, error))]
                yield pa.RecordBatch.from_arrays(columns, [key, "response", "status", "error"])

    asked = rows.select(key, (F.col(text) if isinstance(text, str) else text).alias("__prompt"))
    asked = asked.repartition(parts) if parts else asked
    made = asked.mapInArrow(run, f"`{key}` {kind}, response string, status string, error string")
    return made.withColumn("response", F.from_json("response", shape)) if shape else made


# --- judgments ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Question:
    """What is judged: ``kind`` is yes_no, choice (of ``options``) or scale (places 0.. of ``options``)."""

    instructions: str
    kind: str = "yes_no"
    options: tuple[str, ...] = field(default=())

    def asked(self, name: str) -> str:
        listed = "; ".join(f"{i}: {o}" if self.kind == "scale" else o for i, o in enumerate(self.options))
        return f"{name} ({self.kind}): {self.instructions}" + (f" [{listed}]" if listed else "")

    def checked(self, name: str, value: Any) -> Any:
        fine = {
            "yes_no": isinstance(value, bool), "choice": value in self.options,
            "scale": isinstance(value, int) and not isinstance(value, bool) and 0 <= value < len(self.options),
        }[self.kind]
        if not fine:
            raise Refused(f"{name} is not an answer of kind {self.kind}")
        return value

    @property
    def type(self) -> str:
        return {"yes_no": "boolean", "choice": "string", "scale": "bigint"}[self.kind]


def judge(rows: DataFrame, build: Callable[[], Prompter], key: str, state: Column, questions: dict[str, Question], **options: Any) -> DataFrame:
    """(key, response struct of one field a question, status, error): each question answered about a row's state.

    ``state`` is a struct: nothing else of the row is shown to the model. Where it is null the row is skipped. Answers
    are typed and held against the questions' kinds; options are those of ``prompt``.
    """
    lead = "Answer as one JSON object with these fields.\n" + "\n".join(q.asked(n) for n, q in questions.items()) + "\n"

    def validate(value: dict) -> dict:
        return {n: q.checked(n, value[n]) for n, q in questions.items()}

    text = F.when(state.isNotNull(), F.concat(F.lit(lead), F.to_json(state)))
    shape = ", ".join(f"`{n}` {q.type}" for n, q in questions.items())
    return prompt(rows, build, key, text, validate, returns=shape, **options)


class ErrorBudgetExceeded(RuntimeError):
    """More answers failed than allowed."""


def enforce_budget(answers: DataFrame, most: int) -> dict[str, int]:
    """Counts by status; raises if more than ``most`` neither succeeded nor were skipped."""
    counts = {r.status: r.n for r in answers.groupBy("status").agg(F.count("*").alias("n")).collect()}
    failed = sum(n for s, n in counts.items() if s not in ("success", "skipped"))
    if failed > most:
        raise ErrorBudgetExceeded(f"{failed} answers failed; {most} are allowed: {counts}")
    return counts


class TablePrompter:
    """Answers from a fixed mapping, for tests and replays."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def one(self, prompt: str, system: str | None = None) -> str:
        return self.answers.get(prompt, "")

    def answer(self, prompts: list[str], system: str | None = None) -> list[str]:
        return [self.one(p, system) for p in prompts]


class HttpPrompter:
    """Answers of a service that takes ``{"model", "messages"}`` as JSON and gives ``choices[0].message.content``."""

    def __init__(self, url: str, model: str, key: str = "", timeout: float = 60.0, retries: int = 3, wait: float = 1.0):
        self.url, self.model, self.key, self.timeout, self.retries, self.wait = url, model, key, timeout, retries, wait

    def answer(self, prompts: list[str], system: str | None = None) -> list[str]:
        return [self.one(p, system) for p in prompts]

    def one(self, prompt: str, system: str | None = None) -> str:
        return self._one([*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": self.content(prompt)}])

    def content(self, prompt: str) -> str | list[dict]:
        """What stands for a prompt in the request; parts with images where the prompt is a JSON list of such parts."""
        if prompt.startswith('[{"type"'):
            try:
                parts = json.loads(prompt)
            except ValueError:
                return prompt
            if all(isinstance(p, dict) and p.get("type") in ("text", "image_url") for p in parts):
                return parts
        return prompt

    def _one(self, said: list[dict]) -> str:
        import urllib.error
        import urllib.request

        body = json.dumps({"model": self.model, "messages": said}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        for attempt in range(self.retries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as response:
                    return json.loads(response.read())["choices"][0]["message"]["content"]
            except (urllib.error.URLError, TimeoutError) as e:
                refused = isinstance(e, urllib.error.HTTPError) and e.code < 500 and e.code not in (408, 409, 425, 429)
                if refused or attempt + 1 == self.retries:
                    raise  # a request that the service refuses for what it says is not sent again
                time.sleep(self.wait * 2**attempt)
        raise AssertionError("no attempt was made")
