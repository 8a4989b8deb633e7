"""Signals: a pluggable analysis of documents, defaults, validation, events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled

SIGNAL = "id STRING, ticker STRING, timestamp TIMESTAMP, signal_type STRING, importance INT, sentiment DOUBLE, summary STRING, impact_analysis STRING, raw_metadata MAP<STRING,STRING>"
# fixed values: the signal types
SIGNAL_TYPES = ("M&A", "Earnings", "Legal", "Leadership", "Other")


def source_kind(form: Column) -> Column:
    return F.when(F.upper(form).contains("8-K"), "sec_8k").otherwise("press_release")


def analyzer_input(form: Column, clean: Column) -> Column:
    return F.concat(F.lit("source_type="), source_kind(form), F.lit("\nform="), form, F.lit("\n\n"), clean)


def stub(df: DataFrame, text: Column) -> DataFrame:
    """The built-in provider: fixed values and the input's length in bytes."""
    return df.withColumns(
        {
            "signal_id": F.lit(""),
            "signal_ticker": F.lit(""),
            "signal_timestamp": F.lit(None).cast("timestamp"),
            "signal_type": F.lit("Other"),
            "importance": F.lit(5),
            "sentiment": F.lit(0.0),
            "summary": F.lit("Stub analysis result."),
            "impact_analysis": F.concat(F.lit("Input length: "), F.octet_length(text).cast("string"), F.lit(" chars")),
            "raw_metadata": F.create_map(F.lit("provider"), F.lit("stub")),
        }
    )


def custom(df: DataFrame, key: str, text: str, analyze: Callable[[str], dict]) -> DataFrame:
    """A provider in Python, in Arrow batches: its signal_type, importance, sentiment and summary, or an error per row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text], strict=True):
                try:
                    s = analyze(t)
                    rows.append((k, s["signal_type"], s["importance"], s["sentiment"], s["summary"], None))
                except Exception as e:  # noqa: BLE001  an analysis that fails is a row with its error
                    rows.append((k, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=[key, "signal_type", "importance", "sentiment", "summary", "error"])
            yield out.astype({"importance": "Int32"})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, signal_type string, importance int, sentiment double, summary string, error string")


def with_defaults(signals: DataFrame, identity: Column, ticker: Column, now: Column) -> DataFrame:
    return signals.withColumns(
        {
            "signal_id": first_filled(F.col("signal_id"), F.concat(F.lit("signal:"), identity)),
            "signal_ticker": first_filled(F.col("signal_ticker"), ticker),
            "signal_timestamp": F.coalesce("signal_timestamp", now),
        }
    )


def violations() -> Column:
    """Codes of the domain rules that a signal breaks, comma-joined."""
    codes = F.array(
        F.when(~F.coalesce(F.col("signal_type").isin(*SIGNAL_TYPES), F.lit(False)), "signal_type"),
        F.when(~F.coalesce(F.col("importance").between(1, 10), F.lit(False)), "importance"),
        F.when(~F.coalesce(F.col("sentiment").between(-1.0, 1.0), F.lit(False)), "sentiment"),
    )
    return F.array_join(F.array_compact(codes), ",")


def pending(filings: DataFrame, log: DataFrame) -> DataFrame:
    """Filings without a generated signal; failed ones are tried again."""
    done = log.where("type = 'signal_generated'").select(F.col("aggregate_key").alias("identity")).where("identity is not null").distinct()
    return filings.join(done, "identity", "left_anti")


def signal_events(outcomes: DataFrame, now: Column, source: str = "analysis") -> DataFrame:
    """From rows with identity, ticker, cik, accession, error and signal columns."""
    failed = F.col("error").isNotNull()
    kind = F.when(failed, "signal_failed").otherwise("signal_generated")
    good = F.to_json(F.struct(F.col("signal_id").alias("id"), F.col("signal_ticker").alias("ticker"), F.col("signal_timestamp").alias("timestamp"), "signal_type", "importance", "sentiment", "summary", "impact_analysis", "raw_metadata"))
    bad = F.to_json(F.struct("ticker", "cik", F.col("accession").alias("accession_number"), "error"))
    return outcomes.select(F.concat(kind, F.lit(":"), F.col("identity")).alias("id"), kind.alias("type"), now.alias("occurred_at"), F.col("identity").alias("aggregate_key"), F.lit(source).alias("source"), F.when(failed, bad).otherwise(good).alias("data"))
