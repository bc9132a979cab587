"""Robots rules as a dimension table."""

from __future__ import annotations

import urllib.robotparser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import authority, path, scheme

MAX_BYTES = 512 << 10


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)))


@F.pandas_udf(T.BooleanType())
def _allowed(rules: pd.Series, agent: pd.Series, path: pd.Series) -> pd.Series:
    parsers: dict[str, urllib.robotparser.RobotFileParser] = {}
    out = []
    for text, who, where in zip(rules, agent, path):
        if text is None:
            out.append(True)
            continue
        if text not in parsers:
            parsers[text] = urllib.robotparser.RobotFileParser()
            parsers[text].parse(text.encode()[:MAX_BYTES].decode(errors="ignore").splitlines())
        out.append(parsers[text].can_fetch(who, where or "/"))
    return pd.Series(out)


def robots_allowed(requests: DataFrame, robots: DataFrame) -> DataFrame:
    """requests (url, agent) with ``allowed``. robots: origin, status, body; a missing origin and any status of 400 or more allow
    (fail open). The path is matched without its query."""
    rules = robots.select("origin", F.when(F.col("status") < 400, F.col("body")).alias("_rules"))
    joined = requests.withColumn("origin", origin(F.col("url"))).join(rules, "origin", "left")
    return joined.withColumn("allowed", _allowed("_rules", "agent", path(F.col("url")))).drop("_rules")
