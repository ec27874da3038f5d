"""Header, body and text projections over the mail table (one row per mail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailglass import rules
from mailglass.functions.headers import header_block, header_line, header_value, headers_of, unfold, unix_lines
from mailglass.functions.text import first_match


def body_of(raw: Column) -> Column:
    raw = unix_lines(raw)
    cut = F.instr(raw, "\n\n")
    return F.when(cut > 0, F.substring(raw, cut + F.lit(2), F.length(raw))).otherwise(raw)


def extract_headers(mail: DataFrame) -> DataFrame:
    """From, To, Subject and Date of each mail, unfolded and decoded; null when a header is absent."""
    headers = headers_of(F.col("raw"))
    return mail.withColumns({
        "header_from": first_match(header_value(headers, "From"), r"^(?:[^<]*<)?([^>]+)>?"),
        "header_to": header_value(headers, "To"),
        "header_subject": header_value(headers, "Subject"),
        "header_date": header_line(headers, "Date"),
    })


def first_header_line(mail: DataFrame, prefix: str, alias: str) -> DataFrame:
    """First line that starts with ``prefix``, without the prefix (no regex)."""
    hits = F.filter(F.split(unix_lines(F.col("raw")), "\n"), lambda line: F.startswith(line, F.lit(prefix)))
    first = F.try_element_at(hits, F.lit(1))
    return mail.withColumn(alias, F.trim(F.substring(first, F.lit(len(prefix) + 1), F.length(first))))


def split_parts(mail: DataFrame) -> DataFrame:
    """Headers, subject and body, split on the first blank line."""
    headers = header_block(F.col("raw"))
    return mail.withColumns({
        "headers": headers,
        "part_subject": F.coalesce(header_value(unfold(headers), "Subject"), F.lit("")),
        "part_body": F.trim(body_of(F.col("raw"))),
    })


def strip_markup(text: Column) -> Column:
    """Tags to blanks, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def model_text(df: DataFrame, subject: str = "subject", body: str = "body", alias: str = "text") -> DataFrame:
    """Subject and body joined; the one that is present when the other is not."""
    s, b = F.col(subject), F.col(body)
    return df.withColumn(alias, F.when(s.isNotNull() & b.isNotNull(), F.concat(s, F.lit("\n\n"), b))
                         .otherwise(F.coalesce(b, s, F.lit(""))))


def format_for_scoring(df: DataFrame, subject: str, body: str, html: str, alias: str = "content") -> DataFrame:
    """Rebuild a minimal mail from a message's fields."""
    head = F.concat(F.lit("Subject: "), F.coalesce(F.col(subject), F.lit("")), F.lit("\n"))
    typed = F.when(F.coalesce(F.col(html), F.lit(False)),
                   F.concat(head, F.lit("Content-Type: text/html; charset=UTF-8\n"))).otherwise(head)
    return df.withColumn(alias, F.concat(typed, F.lit("\n"), F.col(body)))


def normalize_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Two-class name (null when unmapped) and number (0 when unmapped)."""
    names = F.create_map(*[F.lit(x) for pair in rules.LABEL_NAMES.items() for x in pair])
    numbers = F.create_map(*[F.lit(x) for pair in rules.LABEL_NUMBERS.items() for x in pair])
    df = df.withColumn("label_name", F.try_element_at(names, F.col(label)))
    source = F.coalesce(F.col("label_name"), F.col(label))
    return df.withColumn("label_number", F.coalesce(F.try_element_at(numbers, source), F.lit(0)))


RECEIVED = r"Received:\s+from\s+([^\s\[\]]+)(?:\s+\(?\[([^\]]+)\])?"
DATE = r"(?m)^Date:\s*(?:[A-Za-z]{3},\s+)?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}\s+[+-]\d{4})"


def header_metadata(mail: DataFrame, compat: bool = False) -> DataFrame:
    """Date as written (local hour and weekday included), Received hops,
    origin address and the envelope headers.

    The origin is the earliest hop, i.e. the last Received line; ``compat``
    takes the first one.
    """
    df = mail.withColumn("_h", headers_of(F.col("raw")))
    df = df.withColumn("date_text", first_match(F.col("_h"), DATE))
    hops = F.filter(F.regexp_extract_all(F.col("_h"), F.lit(RECEIVED), F.lit(2)), lambda x: x != "")
    # the stamp without its zone is the sender's wall clock
    local = F.try_to_timestamp(F.regexp_extract("date_text", r"^(.*)\s+[+-]\d{4}$", 1), F.lit("d MMM yyyy H:m:s"))
    df = df.withColumns({
        "sent_utc": F.try_to_timestamp(F.col("date_text"), F.lit("d MMM yyyy H:m:s Z")),
        "_local": local,
        "zone": first_match(F.col("date_text"), r"([+-]\d{4})$"),
        "received_domains": F.regexp_extract_all(F.col("_h"), F.lit(RECEIVED), F.lit(1)),
        "received_ips": hops,
        "return_path": first_match(F.col("_h"), r"(?m)^Return-Path:\s*<([^>]+)>"),
        "reply_to": first_match(F.col("_h"), r"(?m)^Reply-To:\s*<?([^>\s]+)>?"),
        "x_mailer": header_value(F.col("_h"), "X-Mailer"),
    })
    return df.withColumns({
        "local_date": F.date_format("_local", "yyyy-MM-dd"),
        "local_time": F.date_format("_local", "HH:mm:ss"),
        "local_hour": F.hour("_local"),
        "local_weekday": F.weekday("_local"),
        "received_count": F.size("received_domains"),
        "origin_ip": F.try_element_at("received_ips", F.lit(1 if compat else -1)),
    }).drop("_h", "_local")


def preview(text: Column, length: int = 100) -> Column:
    """Leading characters with an ellipsis when the text goes on."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def with_component_defaults(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """Replace the missing score of a failed component by its default.

    ``scores`` maps component name to its column.
    """
    return df.withColumns({
        column: F.coalesce(F.col(column), F.lit(rules.FAILED_COMPONENT_SCORES[name]))
        for name, column in scores.items()})


def quarantine(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """Split into (usable rows, failed rows); null counts as not failed."""
    bad = F.coalesce(failed, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def drop_tiny_images(images: DataFrame, minimum: int = 20) -> DataFrame:
    return images.filter((F.col("width") >= minimum) & (F.col("height") >= minimum))
