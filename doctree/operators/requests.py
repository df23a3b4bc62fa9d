"""Questions to a model as tables, and answers back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import count_tokens, parse_page_number, parse_physical_index, read_json
from ..sources.scratch import cut, keep, shared_dir
from .membership import likely_members, parted_by_members

#: What each stage asks; {name} stands for a column.
PROMPTS = {
    "toc_page": "Is the following page part of a table of contents? Answer as JSON: {{\"answer\": \"yes\" or \"no\"}}.\n\n{text}",
    "page_numbers": "Does this table of contents give page numbers? Answer as JSON: {{\"answer\": \"yes\" or \"no\"}}.\n\n{toc_content}",
    "appears": "Does the section \"{title}\" begin on or stand on this page? Answer as JSON: {{\"answer\": \"yes\" or \"no\", \"at_start\": \"yes\" or \"no\"}}.\n\n{text}",
    "locate": "On which of these pages does the section \"{title}\" begin? Answer as JSON: {{\"physical_index\": \"<physical_index_N>\", \"confidence\": \"high\" or \"low\"}}.\n\n{text}",
    "entries": "List the entries of this table of contents. Answer as JSON: {{\"items\": [{{\"structure\": \"1.2\", \"title\": \"..\", \"page\": 5}}]}}.\n\n{toc_content}",
    "headings": "List the headings of these pages. Answer as JSON: {{\"items\": [{{\"structure\": \"1.2\", \"title\": \"..\", \"physical_index\": \"<physical_index_N>\"}}]}}.\n\n{text}",
    "description": "Describe the document with these sections in one sentence. Answer as JSON: {{\"text\": \"..\"}}.\n\n{text}",
    "summary": "Summarise this section in a few sentences. Answer as JSON: {{\"text\": \"..\"}}.\n\n{text}",
    "answer": "Answer the question from these pages of {doc_name}.\n\nQuestion: {question}\n\n{text}",
}


def _filled(template: str) -> Column:
    """The template as a concatenation of its text and its columns; null columns are empty."""
    parts, rest = [], template.replace("{{", "\x00").replace("}}", "\x01")
    clean = lambda s: s.replace("\x00", "{").replace("\x01", "}")
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(clean(head)), F.coalesce(F.col(name).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(clean(rest)))


def _asked(stage: str) -> tuple[Column, Column]:
    """The prompt of a row and its request_id."""
    prompt = _filled(PROMPTS[stage])
    return prompt, F.sha2(F.concat_ws("\n", "doc_id", F.lit(stage), prompt), 256)


def _fresh_ids(keyed: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, int, DataFrame, int]:
    """(ids, their number, others, their number) of rows (request_id, ..): ids that seen lacks, and those that must not be taken as they come.

    The others are ids of several rows, and ids that seen has. Only ids are shuffled.
    """
    counts = cut(keyed.groupBy("request_id").agg(F.count("*").alias("n")))
    fresh = counts.select("request_id") if seen is None else cut(counts.join(seen, "request_id", "left_anti").select("request_id"))
    others = counts.filter("n > 1").select("request_id")
    if seen is not None:
        others = cut(others.union(counts.join(fresh, "request_id", "left_anti").select("request_id")).distinct())
    return fresh, fresh.count(), others, others.count()


def _once(keyed: DataFrame, fresh: DataFrame, n: int, others: DataFrame, m: int) -> DataFrame:
    """A row of keyed for each fresh id. Rows that a bitmap takes for others, and few more, are shuffled; all others stay where they are."""
    if not m:
        return keyed
    maybe, sure = parted_by_members(likely_members(keyed, fresh, ["request_id"], n), others, ["request_id"], m)
    return sure.unionByName(maybe.join(fresh, "request_id", "left_semi").dropDuplicates(["request_id"]))


def make_requests(stage: str, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(request_id, doc_id, stage, keys.., prompt, est_tokens) for rows of df, of which keys are columns.

    Equal questions about a document are one request, with the keys of one of them. Ids are compared first, without
    their prompts; of prompts only those that may be repeated are shuffled. df is read several times: `cut` what is dear.
    """
    prompt, key = _asked(stage)
    asked = df.select(key.alias("request_id"), "doc_id", F.lit(stage).alias("stage"), *keys, prompt.alias("prompt")).withColumn("est_tokens", count_tokens("prompt"))
    return _once(asked, *_fresh_ids(asked.select("request_id"), None))


_ANSWER = "answer string, at_start string, physical_index string, confidence string, text string, items array<struct<structure:string,title:string,page:string,physical_index:string>>"


def parse_responses(responses: DataFrame) -> DataFrame:
    """(request_id, answer, at_start, physical_index, confidence, text, items, ok) from (request_id, response).

    answer and at_start are booleans; at_start is false and confidence low if absent. items are (structure, title,
    page, physical_index), those without a title left out. ok is false for an empty or unreadable response and for an
    answer that is neither yes nor no.
    """
    read = responses.withColumn("_r", read_json("response", _ANSWER))
    yes = lambda c: F.when(F.lower(c) == "yes", True).when(F.lower(c) == "no", False)
    ok = F.col("_r").isNotNull() & (F.col("_r.answer").isNull() | yes(F.col("_r.answer")).isNotNull())
    item = lambda x: F.struct(
        F.nullif(F.trim(x["structure"]), F.lit("")).alias("structure"), F.trim(x["title"]).alias("title"), parse_page_number(x["page"]).alias("page"), parse_physical_index(x["physical_index"], bare_int=True).alias("physical_index")
    )
    return read.select(
        "request_id",
        yes(F.col("_r.answer")).alias("answer"),
        F.coalesce(yes(F.col("_r.at_start")), F.lit(False)).alias("at_start"),
        parse_physical_index(F.col("_r.physical_index")).alias("physical_index"),
        F.coalesce(F.col("_r.confidence"), F.lit("low")).alias("confidence"),
        F.col("_r.text").alias("text"),
        F.filter(F.transform("_r.items", item), lambda x: x["title"] != "").alias("items"),
        ok.alias("ok"),
    )


_OPEN = "request_id string, doc_id string, stage string, key string, prompt string, est_tokens int"


class Answers:
    """Responses (request_id, response) to the requests of all stages, as a job takes them; what they leave open is written down.

    A job that is given Answers asks for every judgement and lets what was answered replace its rule. `open` then
    holds the requests that had no response, to be answered before the next run: each stage appends its new ones to
    a written table, so that reading them repeats nothing of the job.
    """

    def __init__(self, responses: DataFrame):
        self._spark = responses.sparkSession
        self._given = keep(parse_responses(responses).filter("ok").dropDuplicates(["request_id"]))
        self._seen = keep(responses.select("request_id").distinct())
        self._path, self._stages = f"{shared_dir(self._spark)}/{uuid.uuid4().hex}-requests", 0

    def apply(self, stage: str, rows: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
        """rows (doc_id and what the stage's question names) with each column replaced by that field of the response that is not null.

        keys are the columns that tell the rows of a document apart; `open` shows them.
        """
        prompt, key = _asked(stage)
        key_json = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
        asked = rows.select(key.alias("request_id"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(stage).alias("stage"), key_json.alias("key"), prompt.alias("prompt"))
        fresh, n, others, m = _fresh_ids(asked.select("request_id"), self._seen)
        if n:
            new = _once(asked.withColumn("est_tokens", count_tokens("prompt")), fresh, n, others, m)
            new.write.mode("append").parquet(self._path)
            self._seen, self._stages = keep(self._seen.union(fresh)), self._stages + 1
        given = self._given.select(F.col("request_id").alias("_request"), *[F.col(field).alias(f"_given_{c}") for c, field in columns.items()])
        out = rows.withColumn("_request", key).join(given, "_request", "left").withColumns({c: F.coalesce(f"_given_{c}", c) for c in columns})
        return out.select(*rows.columns)

    @property
    def open(self) -> DataFrame:
        """(request_id, doc_id, stage, key, prompt, est_tokens) of all that was asked and has no response; key is JSON of the row's keys."""
        if not self._stages:
            return self._spark.createDataFrame([], _OPEN)
        return self._spark.read.schema(_OPEN).parquet(self._path)


class PartAnswers:
    """Answers for rows whose doc_id names a part of a document: questions are about the document, and their keys name the part.

    document turns a part's doc_id into that of its document.
    """

    def __init__(self, answers: Answers, document: Callable[[Column], Column]):
        self._answers, self._document = answers, document

    def apply(self, stage: str, rows: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
        of_document = rows.withColumn("part", F.col("doc_id")).withColumn("doc_id", self._document(F.col("part")))
        return self._answers.apply(stage, of_document, ["part", *keys], **columns).withColumn("doc_id", F.col("part")).select(*rows.columns)


def with_answers(rules: DataFrame, responses: DataFrame, column: str) -> DataFrame:
    """Rules (request_id, column, ..) with column from the responses (request_id, column) that are not null."""
    given = responses.select("request_id", F.col(column).alias("_given"))
    return rules.join(given, "request_id", "left").withColumn(column, F.coalesce("_given", column)).select(*rules.columns)


class _Runner:
    """Gives one frame at a time to the user's fn, and begins it anew after an error."""

    def __init__(self, fn, attempts: int):
        self._fn, self._attempts, self._next, self._running = fn, attempts, None, None

    def _frames(self) -> Iterator[pd.DataFrame]:
        while True:
            yield self._next

    def __call__(self, frame: pd.DataFrame) -> pd.DataFrame:
        """(request_id, response, error) for each row of frame: what fails together is asked row by row."""
        error = "no response"
        for _ in range(self._attempts):
            try:
                self._next = frame
                self._running = self._running or self._fn(self._frames())
                out = next(self._running)[["request_id", "response"]].drop_duplicates("request_id")
                both = frame[["request_id"]].merge(out, "left", "request_id")
                lost = both["response"].isna() | (both["response"].astype("string").str.strip() == "")
                if not lost.all() or len(frame) > 1:
                    return both.assign(error=lost.map({True: "no response", False: None}))
            except StopIteration:
                self._running = None
            except Exception as e:
                self._running, error = None, f"{type(e).__name__}: {e}"[:1000]
        if len(frame) > 1:
            return pd.concat([self(frame.iloc[i : i + 1]) for i in range(len(frame))])
        return frame[["request_id"]].assign(response=None, error=error)


def run_model(requests: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], batch: int = 64, attempts: int = 3) -> DataFrame:
    """(request_id, response, error) by the user's fn, a row for each different request_id of requests (request_id, prompt).

    fn takes frames (request_id, prompt) of at most `batch` rows and yields a frame (request_id, response) for each; it may
    load what it needs before the first. A frame on which it fails `attempts` times is given to it row by row, so one
    request that cannot be answered costs no other; it gets a null response and the error. An empty response and one
    that fn leaves out are errors too. Responses to ids that were not asked do not count.
    """

    def run(batches):
        runner = _Runner(fn, attempts)
        for pdf in batches:
            pdf = pdf.drop_duplicates("request_id")
            for low in range(0, len(pdf), batch):
                yield runner(pdf.iloc[low : low + batch])

    answered = requests.select("request_id", "prompt").mapInPandas(run, "request_id string, response string, error string")
    # Prompts do not move; of answers to one request in several batches one with a response stays.
    best = F.max_by(F.struct("response", "error"), F.col("response").isNotNull())
    return answered.groupBy("request_id").agg(best.alias("_r")).select("request_id", "_r.response", "_r.error")
