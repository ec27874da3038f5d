"""MIME bodies. Decoding a message is the one step that needs the standard
library's parser; it runs in Arrow batches and everything after it is native."""

from __future__ import annotations

from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailglass.operators.mail import strip_markup


def _text_of(part) -> str:
    payload = part.get_payload(decode=True)
    return payload.decode("utf-8", errors="ignore") if payload is not None else ""


def _parts(raw: str, plain_only: bool) -> tuple:
    try:
        message = message_from_bytes((raw or "").encode("utf-8", errors="ignore"), policy=policy.compat32)
        wanted = ("text/plain",) if plain_only else ("text/plain", "text/html")
        if message.is_multipart():
            texts = [_text_of(p) + "\n" for p in message.walk() if p.get_content_type() in wanted]
            body = "".join(texts)
        else:
            body = _text_of(message)
        return body, None
    except Exception as error:  # one broken mail must not fail the job
        return raw, str(error)


def mime_bodies(mail: DataFrame, key: str = "mail_id", raw: str = "raw", plain_only: bool = False) -> DataFrame:
    """(key, body, error): text parts joined, markup stripped, blanks collapsed."""
    kind = mail.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [_parts(text, plain_only) for text in frame[raw]]
            yield pd.DataFrame({key: frame[key], "body": [d[0] for d in done], "error": [d[1] for d in done]})

    df = mail.select(key, raw).mapInPandas(run, f"{key} {kind}, body string, error string")
    return df.withColumn("body", strip_markup(F.col("body")))
