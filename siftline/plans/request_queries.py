"""Queries of request gates, defaults, presets and cache writes, on inputs derived from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, requests
from ..functions.urls import scheme
from ..operators import cache
from ..session import table
from .registry import query

# request options by the digits of an order's key -------------------------------------------------------------------

_SQL_ADMIN = "o_orderkey % 2 = 0"


def _key() -> Column:
    return F.col("o_orderkey")


def _admin() -> Column:
    return _key() % 2 == 0


def _when(n: int, r: int, x: object) -> Column:
    return F.when(_key() % n == r, x)


@query(
    "option_gates",
    f"""WITH r AS (SELECT o_orderkey, {_SQL_ADMIN} AS admin, CASE o_orderkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS robots, CASE o_orderkey % 5 WHEN 0 THEN 'http://proxy' WHEN 1 THEN '' END AS proxy FROM orders)
    SELECT o_orderkey, CASE WHEN admin THEN NULL WHEN robots IS NOT DISTINCT FROM false THEN 'forbidden: respect_robots=false requires admin key' WHEN proxy <> '' THEN 'forbidden: proxy_url requires admin key' END AS error FROM r""",
)
def option_gates(spark: SparkSession, folder: str) -> DataFrame:
    robots, proxy = _when(3, 0, False).when(_key() % 3 == 1, True), _when(5, 0, "http://proxy").when(_key() % 5 == 1, "")
    return table(spark, folder, "orders").select("o_orderkey", requests.option_error(_admin(), robots, proxy).alias("error"))


def _thinking() -> Column:
    made = F.struct((_key() % 4 == 1).alias("enabled"), ((_key() % 23) * 100).cast("int").alias("budget_tokens"), F.lit("low").alias("effort"))
    return F.when(_key() % 4 != 0, made)


_SQL_BUDGET = "CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 23) * 100 END"
_SQL_SMALL = f"o_orderkey % 4 = 1 AND {_SQL_BUDGET} BETWEEN 1 AND 1023"


@query(
    "override_validation",
    f"""WITH r AS (SELECT o_orderkey, {_SQL_ADMIN} AS admin, CASE o_orderkey % 7 WHEN 0 THEN 'm' WHEN 1 THEN ' ' END AS model, CASE o_orderkey % 11 WHEN 0 THEN 'p' END AS provider, {_SQL_BUDGET} AS budget,
      o_orderkey % 3000 - 100 AS tokens, (o_orderkey % 13 - 1) * 15000 AS timeout, o_orderpriority AS instructions FROM orders)
    SELECT o_orderkey, CASE WHEN model = 'm' AND NOT admin THEN 'model override not allowed' WHEN provider = 'p' AND NOT admin THEN 'provider override not allowed'
      WHEN tokens > 2000 THEN 'max_tokens over cap' WHEN budget > 2000 THEN 'thinking budget_tokens over cap' WHEN timeout < 0 THEN 'timeout_ms must be >= 0' WHEN timeout > 120000 THEN 'timeout_ms over cap'
      WHEN strlen(instructions) > 10 THEN 'instructions over cap' END AS error FROM r""",
)
def override_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Thinking may be overridden by all keys, model and provider by admins."""
    model, provider = _when(7, 0, "m").when(_key() % 7 == 1, " "), _when(11, 0, "p")
    error = requests.override_error(_admin(), model, provider, _thinking(), _key() % 3000 - 100, (_key() % 13 - 1) * 15000, F.col("o_orderpriority"), ["thinking"], 2000, 120_000, 10)
    return table(spark, folder, "orders").select("o_orderkey", error.alias("error"))


@query(
    "request_validation",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'model required' WHEN o_orderkey % 7 = 0 THEN 'user prompt required' WHEN o_orderkey % 11 = 0 THEN 'max_tokens must be >= 0'
      WHEN {_SQL_SMALL} THEN 'thinking.budget_tokens must be >= 1024 (got ' || {_SQL_BUDGET} || ')' END AS request_error,
    CASE WHEN o_orderkey % 5 = 1 THEN 'name required' WHEN o_orderkey % 7 = 1 THEN 'kind must be "openai" or "anthropic"' WHEN o_orderkey % 5 = 0 THEN 'model required'
      WHEN o_orderkey % 3 = 1 THEN 'base_url: scheme must be http or https' WHEN o_orderkey % 9 = 2 THEN 'base_url: host required' WHEN o_orderkey % 11 = 0 THEN 'timeout must be >= 0'
      WHEN {_SQL_SMALL} THEN 'thinking.budget_tokens must be >= 1024' END AS provider_error FROM orders""",
)
def request_validation(spark: SparkSession, folder: str) -> DataFrame:
    model, signed = _when(5, 0, "\t").otherwise("m"), _when(11, 0, -1).otherwise(1)
    request = requests.request_error(model, _when(7, 0, "\n").otherwise(F.col("o_orderpriority")), signed, _thinking())
    base = _when(3, 1, "file:///etc/hosts").when(_key() % 9 == 2, "https:///v1").when(_key() % 3 == 0, "").otherwise("https://host/v1")
    kind = _when(7, 1, "other").when(_key() % 2 == 0, "openai").otherwise("anthropic")
    provider = requests.provider_error(_when(5, 1, "").otherwise("n"), kind, model, base, signed, _thinking())
    return table(spark, folder, "orders").select("o_orderkey", request.alias("request_error"), provider.alias("provider_error"))


@query(
    "chosen_settings",
    f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus ELSE 'default' END AS model, CASE WHEN o_custkey % 3 + o_orderkey % 4 - 1 > 0 THEN o_custkey % 3 + o_orderkey % 4 - 1 ELSE 100 END AS max_tokens,
    CASE WHEN o_totalprice > 100000 THEN o_totalprice - 100000 ELSE 0.5 END AS temperature, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 = 1 ELSE true END AS enabled, coalesce({_SQL_BUDGET}, 4096) AS budget_tokens,
    CASE WHEN o_orderkey % 4 <> 0 THEN 'low' ELSE 'high' END AS effort, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority ELSE '' END AS title FROM orders""",
)
def chosen_settings(spark: SparkSession, folder: str) -> DataFrame:
    default = F.struct(F.lit(True).alias("enabled"), F.lit(4096).alias("budget_tokens"), F.lit("high").alias("effort"))
    model = requests.choose_text(_when(3, 0, F.col("o_orderstatus")).when(_key() % 3 == 1, " \t"), F.lit("default"))
    tokens = requests.choose_positive(F.col("o_custkey") % 3 + _key() % 4 - 1, F.lit(100))
    price = F.col("o_totalprice").cast("double")
    title = requests.first_set(_when(3, 0, F.col("o_orderstatus")).when(_key() % 3 == 1, ""), _when(3, 1, F.col("o_orderpriority")))
    rows = table(spark, folder, "orders").select(
        "o_orderkey", model.alias("model"), tokens.alias("max_tokens"), requests.choose_positive(price - 100000, F.lit(0.5)).alias("temperature"), requests.merge_thinking(_thinking(), default).alias("t"), title.alias("title")
    )
    return rows.select("o_orderkey", "model", "max_tokens", "temperature", "t.*", "title")


# presets, user agents, cache writes ----------------------------------------------------------------------------------


@query(
    "policy_presets",
    """SELECT page_id, policy, lower(split_part(url, '://', 1)) IN ('http', 'https') AS scheme_allowed, max_redirects, allow_private
    FROM pages, (VALUES ('external', 5, false), ('internal', 5, true)) p(policy, max_redirects, allow_private) WHERE policy = CASE WHEN page_id % 3 = 0 THEN 'internal' ELSE 'external' END""",
)
def policy_presets(spark: SparkSession, folder: str) -> DataFrame:
    """Each page with the preset that its request names."""
    asked = table(spark, folder, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, "internal").otherwise("external").alias("policy"))
    allowed = F.coalesce(F.array_contains("schemes", scheme(F.col("url"))), F.lit(False))
    return asked.join(policy.policies(spark), "policy").select("page_id", "policy", allowed.alias("scheme_allowed"), "max_redirects", "allow_private")


@query(
    "user_agents",
    """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'own' WHEN page_id % 3 = 0 OR page_id % 7 = 0 THEN 'default' ELSE 'pooled' END AS agent FROM pages""",
)
def user_agents(spark: SparkSession, folder: str) -> DataFrame:
    """Pools of one agent or none, as SQL lacks the hash that picks from a longer one."""
    k = F.col("page_id")
    pool = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("pooled")))
    agent = policy.choose_user_agent(F.col("url"), F.when(k % 5 == 0, "own"), F.lit("default"), pool, k % 3 == 0)
    return table(spark, folder, "pages").select("page_id", agent.alias("agent"))


@query("cache_upsert", "SELECT user_id AS key, arg_max(event_id, ts) AS value, max(ts) AS written_at FROM events GROUP BY user_id")
def cache_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the month as the stored artifacts, the rest as writes."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("written_at"))
    before = F.col("written_at") <= F.lit("2024-01-15 12:00:00").cast("timestamp")
    return cache.upsert(events.filter(before), events.filter(~before))


_NOW = "2024-01-15 12:00:00"


@query(
    "robots_cache",
    f"""WITH e AS (SELECT user_id AS origin, arg_max(event_id, ts) AS value, max(ts) AS written_at FROM events WHERE ts < TIMESTAMP '{_NOW}' GROUP BY 1),
    f AS (SELECT user_id AS origin, min(event_id) AS value FROM events WHERE ts >= TIMESTAMP '{_NOW}' AND ts < TIMESTAMP '{_NOW}' + INTERVAL 1 HOUR GROUP BY 1)
    SELECT origin, value, written_at FROM e WHERE written_at > TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR AND origin NOT IN (SELECT origin FROM f) UNION ALL SELECT origin, value, TIMESTAMP '{_NOW}' FROM f""",
)
def robots_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Events before a time as the entries of their users, those of the hour after it as what is fetched."""
    events, now = table(spark, folder, "events"), F.lit(_NOW).cast(table(spark, folder, "events").schema["ts"].dataType)
    entries = events.filter(F.col("ts") < now).select(F.col("user_id").alias("origin"), F.col("event_id").alias("value"), F.col("ts").alias("written_at"))
    fetched = events.filter((F.col("ts") >= now) & (F.col("ts") < now + F.expr("INTERVAL 1 HOUR"))).groupBy(F.col("user_id").alias("origin")).agg(F.min("event_id").alias("value"))
    return cache.insert_and_sweep(cache.latest(entries, "origin"), fetched, now, 24 * 3600)
