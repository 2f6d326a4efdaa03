"""Scores by a remote judge: work list, requests from tasks, and a journal of answers."""

from __future__ import annotations

import http.client
import json
import math
import os
import time
import urllib.error
import urllib.request

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Answers after which a request is made again.
RETRIED = (408, 429, 500, 502, 503, 504)


def identity(*parts: str) -> Column:
    """The digest under which an answer is kept."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON number")


def _finite(text: str) -> float:
    return float(text) if math.isfinite(float(text)) else _no_constant(text)


def _parsed(reply) -> object:
    return json.loads(reply.read(), parse_constant=_no_constant, parse_float=_finite)


def _refused_setting(error: urllib.error.HTTPError, body: dict) -> str:
    """The setting of ours that the server names as wrong; nothing else that it says is passed on, as it may hold secrets."""
    try:
        named = _parsed(error)["error"]["param"]
    except (ValueError, LookupError, TypeError, OSError, http.client.HTTPException):
        return ""
    return f", for {named}" if isinstance(named, str) and named in body else ""


def ask(config: dict, messages: list[dict], opener=urllib.request.urlopen, wait=time.sleep) -> dict:
    """POST the messages with the model and generation settings of ``config`` (see checks.JUDGE) and return the JSON answer.

    The key is read from the environment as the request is made. Failures of
    the transport and answers RETRIED are tried again; every failure in the
    end is a RuntimeError or ValueError.
    """
    headers = {"Content-Type": "application/json"}
    if name := config.get("api_key_env"):
        if not os.environ.get(name):
            raise ValueError(f"the environment has no {name}")
        headers["Authorization"] = f"Bearer {os.environ[name]}"
    body = {"model": config["model"], "messages": messages, "stream": False} | config.get("generation_kwargs", {})
    request = urllib.request.Request(config["endpoint"], json.dumps(body, allow_nan=False).encode(), headers)
    retries = config.get("max_retries", 2)
    for attempt in range(retries + 1):
        why, again = "cannot be reached", True
        try:
            with opener(request, timeout=config.get("timeout", 60)) as reply:
                answer = _parsed(reply)
            if isinstance(answer, dict):
                return answer
            raise ValueError("the judge's answer is no JSON object")
        except urllib.error.HTTPError as error:
            why, again = f"answered with status {error.code}{_refused_setting(error, body)}", error.code in RETRIED
        except (OSError, http.client.HTTPException):
            # Time-outs, dropped connections and answers that end too soon are no URLError.
            pass
        if not again or attempt == retries:
            raise RuntimeError(f"the judge {why}")
        wait(min(2**attempt, 8))
    raise AssertionError


def checked_scores(scores: dict, metrics: list[str]) -> dict[str, float]:
    """Exactly the declared metrics, all finite numbers."""
    if set(scores) != set(metrics):
        raise ValueError(f"scores {sorted(scores)} are not the declared {sorted(metrics)}")
    out = {k: float(v) for k, v in scores.items() if not isinstance(v, bool)}
    if len(out) < len(scores) or not all(map(math.isfinite, out.values())):
        raise ValueError("a score is no finite number")
    return out


def judge(work: DataFrame, config: dict, prompt, score, metrics: list[str]) -> DataFrame:
    """(identity, status, scores) of each row of (identity, record): ``prompt`` makes messages of a record, ``score`` numbers of an answer.

    Requests go from tasks to the judge of ``config``. A failure, time-outs included, is a row of its own and does not
    end the job; add_to_journal() keeps all, and to_ask() asks again what has no success.
    """

    def rows(batches):
        for batch in batches:
            out = []
            for record in batch.column(1).to_pylist():
                try:
                    out.append(("success", checked_scores(score(record, ask(config, prompt(record))), metrics)))
                except (RuntimeError, ValueError):
                    out.append(("failed", {}))
            yield pa.RecordBatch.from_pydict({"identity": batch.column(0), "status": [s for s, _ in out], "scores": pa.array([list(x.items()) for _, x in out], pa.map_(pa.string(), pa.float64()))})

    return work.select("identity", "record").mapInArrow(rows, "identity string, status string, scores map<string,double>")


def to_ask(asked: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows whose identity has no success in the journal."""
    return asked.join(journal.where("status = 'success'").select("identity").distinct(), "identity", "left_anti")


_JOURNAL = "identity string, status string, scores map<string,double>, written timestamp"


def journal(spark: SparkSession, path: str) -> DataFrame:
    """One row per identity: its first success, else its last other status."""
    try:
        rows = spark.read.schema(_JOURNAL).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        rows = spark.createDataFrame([], _JOURNAL)
    done = F.col("status") == "success"
    since = F.unix_micros("written")
    rank = F.struct(done.alias("done"), F.when(done, -since).otherwise(since).alias("at"))
    return rows.groupBy("identity").agg(F.max_by(F.struct("status", "scores", "written"), rank).alias("j")).select("identity", "j.*")


def add_to_journal(answers: DataFrame, path: str) -> None:
    """Append (identity, status, scores); a status is pending, success or failed."""
    if bad := answers.where(~F.col("status").isin("pending", "success", "failed")).take(1):
        raise ValueError(f"not a status: {bad[0].status}")
    answers.select("identity", "status", "scores", F.current_timestamp().alias("written")).write.mode("append").parquet(path)
