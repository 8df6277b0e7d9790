"""Delivering request bodies from the executors.

``sawlog_delivery`` writes rows with an ``id`` and a ``body``. Each task sends its own rows through
a transport; a task that is run again sends the same ids, so the receiver can tell repeats.

A transport returns what the receiver answered, or None where it does not answer. Bulk answers are read whole, whatever their length:
of a body some of whose documents failed, only those are sent again.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
import uuid
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage,
)

from sawlog.operators.batching import bulk_bodies, webhook_payloads
from sawlog.sinks.answers import Answer, AnswerError, pieces_of, read_answer

FORMAT = "sawlog_delivery"

# Retry and time limits of the bulk protocol.
BULK_TRIES = 3
RETRY_BASE_SECONDS, RETRY_MAX_SECONDS = 0.5, 30.0
HTTP_TIMEOUT_SECONDS = 30.0
TOLD = 3  # refused documents that an error message names


class DeliveryError(RuntimeError):
    """A body the receiver did not take."""


@dataclass
class Sent(WriterCommitMessage):
    count: int
    file: str | None = None


def retry_wait(attempt: int) -> float:
    """Seconds before try number ``attempt`` (from 0)."""
    return 0.0 if attempt == 0 else min(RETRY_BASE_SECONDS * 2.0 ** (attempt - 1), RETRY_MAX_SECONDS)


Send = Callable[[str, str, int], Answer | None]


def documents_of(body: str) -> list[str]:
    """The documents of a bulk body, each with its action line."""
    lines = body.split("\n")
    return ["\n".join(lines[i : i + 2]) + "\n" for i in range(0, len(lines) - 1, 2)]


def _refusal(refused: dict[int, tuple[int, str]], what: str) -> DeliveryError:
    named = "; ".join(f"document {place}: {status} {reason}".rstrip() for place, (status, reason) in list(refused.items())[:TOLD])
    return DeliveryError(f"{len(refused)} documents {what} ({named})")


def deliver(send: Send, body_id: str, body: str, tries: int, sleep=time.sleep) -> None:
    """Send with back-off; the last failure is raised.

    Where the answer tells which documents of a bulk body failed, the next try sends only those that a further try may mend. Documents
    refused for good do not keep the others from being sent; they raise in the end.
    """
    failure: Exception | None = None
    places = None  # of the documents still to be sent, in the body as it was given
    whole = documents = None
    refused: dict[int, tuple[int, str]] = {}
    for attempt in range(max(tries, 1)):
        sleep(retry_wait(attempt))
        try:
            answer = send(body_id, body, attempt)
        except (DeliveryError, AnswerError, OSError) as error:
            failure = error
            continue
        if answer is None or not (answer.errors or answer.failed):
            failure = None
            break
        if not answer.failed:
            failure = DeliveryError("the answer reports errors, but no failed document")
            continue
        if documents is None:
            whole = documents_of(body)
            documents, places = whole, list(range(len(whole)))
        if answer.items != len(documents):
            failure = DeliveryError(f"the answer has {answer.items} items for {len(documents)} documents")
            continue
        refused |= {places[place]: told for place, told in answer.refused().items()}
        again = answer.again()
        if not again:
            failure = None
            break
        failure = _refusal({places[place]: answer.failed[place] for place in again}, "failed")
        places = [places[place] for place in again]
        documents = [whole[place] for place in places]
        body = "".join(documents)
    if failure is not None:
        raise DeliveryError(f"delivery failed after {max(tries, 1)} tries: {failure}")
    if refused:
        raise _refusal(dict(sorted(refused.items())), "were refused")


def directory_transport(options: dict) -> Send:
    """One file per body; a body sent again replaces itself."""
    folder = options["path"]

    def send(body_id: str, body: str, attempt: int) -> None:
        os.makedirs(folder, exist_ok=True)
        partial = os.path.join(folder, f".{body_id}.{os.getpid()}")
        with open(partial, "w", encoding="utf-8", newline="") as file:
            file.write(body)
        os.replace(partial, os.path.join(folder, body_id))

    return send


class Spool:
    """The bodies of one task in one hidden file, a line of JSON each, which is shown when the whole write has ended.

    ``directory`` makes a file per body, and to list millions of them takes more memory than a driver has.
    """

    def __init__(self, options: dict):
        os.makedirs(options["path"], exist_ok=True)
        self.place = os.path.join(options["path"], f".{uuid.uuid4().hex}.json")
        self.file = None

    def __call__(self, body_id: str, body: str, attempt: int) -> None:
        if not (isinstance(body_id, str) and isinstance(body, str)):
            raise DeliveryError(f"body {body_id} or its id is not a text")
        if self.file is None:
            self.file = open(self.place, "w", encoding="utf-8", newline="")
        self.file.write(json.dumps({"id": body_id, "body": body}, ensure_ascii=False) + "\n")

    def close(self) -> str | None:
        """Ends the file and tells its place, if there was a body."""
        if self.file is None:
            return None
        self.file.close()
        return self.place


def shown(place: str) -> str:
    """The place of a spool file once it counts."""
    folder, name = os.path.split(place)
    return os.path.join(folder, name.removeprefix("."))


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """``(id, body)`` of what is spooled in a folder. A body that was sent again, under the same id, counts once."""
    return spark.read.schema("id string, body string").json(path).dropDuplicates(["id"])


def replay_transport(options: dict) -> Send:
    """Bodies as files, and answers as files: what was sent in try ``n`` is ``<id>.<n>`` in ``path``, and its answer is read from ``<id>.<n>`` in ``answers``.

    For tests of receivers, and to play a recorded delivery again.
    """
    answers, written = options["answers"], {}

    def send(body_id: str, body: str, attempt: int) -> Answer | None:
        folder = written.setdefault("send", directory_transport(options))
        folder(f"{body_id}.{attempt}", body, attempt)
        try:
            with open(os.path.join(answers, f"{body_id}.{attempt}"), "rb") as file:
                return read_answer(pieces_of(file))
        except FileNotFoundError:
            return None

    return send


def check_response(status: int, pieces: Iterable[bytes]) -> Answer:
    """The answer to a request that was taken; an error status, and an answer that is neither empty nor whole, raise."""
    if status >= 400:
        raise DeliveryError(f"HTTP {status}")
    try:
        return read_answer(pieces)
    except AnswerError as error:
        raise DeliveryError(f"the answer can't be read: {error}") from error


def http_transport(options: dict) -> Send:
    """POST to one of the hosts, another one at each try. With ``answers`` set to ``bulk``, the answer tells what became of each document."""
    hosts = [h.strip().rstrip("/") for h in options["hosts"].split(",")]
    headers = {"Content-Type": options.get("contenttype", "application/json")}
    if options.get("username"):
        pair = f"{options['username']}:{options.get('password', '')}".encode()
        headers["Authorization"] = "Basic " + base64.b64encode(pair).decode()

    def send(body_id: str, body: str, attempt: int) -> Answer | None:
        host = hosts[(zlib.crc32(body_id.encode()) + attempt) % len(hosts)]
        request = urllib.request.Request(host + options.get("endpoint", ""), body.encode(), headers, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=HTTP_TIMEOUT_SECONDS) as response:
                pieces = pieces_of(response) if options.get("answers") == "bulk" else ()
                return check_response(response.status, pieces)
        except urllib.error.HTTPError as error:
            raise DeliveryError(f"HTTP {error.code}") from error

    return send


TRANSPORTS = {"directory": directory_transport, "spool": Spool, "http": http_transport, "replay": replay_transport}


class _Writing:
    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        send = TRANSPORTS[self.options.get("transport", "directory")](self.options)
        tries = int(self.options.get("tries", "1"))
        count = 0
        for row in iterator:
            deliver(send, row["id"], row["body"], tries)
            count += 1
        return Sent(count, send.close() if isinstance(send, Spool) else None)

    def _show(self, messages) -> None:
        """Only files of tasks that count are shown, so a task that ran twice leaves nothing twice."""
        for sent in messages:
            if sent is not None and sent.file is not None:
                os.replace(sent.file, shown(sent.file))

    def _drop(self, messages) -> None:
        for sent in messages:
            if sent is not None and sent.file is not None and os.path.exists(sent.file):
                os.remove(sent.file)


class DeliveryWriter(_Writing, DataSourceWriter):
    def commit(self, messages):
        self._show(messages)

    def abort(self, messages):
        self._drop(messages)


class DeliveryStreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        self._show(messages)

    def abort(self, messages, batchId):
        self._drop(messages)


class DeliverySource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "id string, body string"

    def writer(self, schema, overwrite):
        return DeliveryWriter(self._plain())

    def streamWriter(self, schema, overwrite):
        return DeliveryStreamWriter(self._plain())

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeliverySource)


def send_bodies(bodies: DataFrame, transport: dict, tries: int = 1) -> None:
    """Send ``bodies(id, body)``; ``transport`` names its kind and settings, all as text."""
    register(bodies.sparkSession)
    options = {"transport": "directory", "tries": str(tries)} | transport
    bodies.select("id", "body").write.format(FORMAT).options(**options).mode("append").save()




def write_bulk(df: DataFrame, index: str, transport: dict, size: int | None = None, tries: int = BULK_TRIES) -> None:
    """Index lines by bulk requests; documents have ids, so a request sent twice adds nothing, and one that failed in part is sent again in part."""
    bodies = bulk_bodies(df, index, size, with_ids=True).withColumnRenamed("bulk_body", "body")
    body_id = F.concat(F.lit("bulk-"), F.sha2("body", 256))  # documents have ids, so no two bodies are alike
    settings = {"endpoint": "/_bulk", "contentType": "application/x-ndjson", "answers": "bulk"} | transport
    send_bodies(bodies.withColumn("id", body_id), settings, tries if tries > 0 else BULK_TRIES)


def write_webhook(df: DataFrame, transport: dict, sent_at, min_level: str | None = None, size: int | None = None) -> None:
    """Send lines to a webhook in batches, one try each.

    A body is known by its batch and the ids of its first and last line, so equal lines in different batches are all
    delivered, and a repeated write sends the same ids.
    """
    bodies = webhook_payloads(df, sent_at, min_level, size).withColumnRenamed("payload", "body")
    body_id = F.concat_ws("-", F.lit("webhook"), *[F.col(c).cast("string") for c in ("batch", "first_id", "last_id")])
    send_bodies(bodies.withColumn("id", body_id), transport)
