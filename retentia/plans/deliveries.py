"""Problem 3: requests delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentia.operators.delivery import once_per_id
from retentia.plans.registry import Registry
from retentia.sources.tables import table

registry = Registry()

_ID = r"lower(trim(custom_id, E' \t\n\r\f\x0b '))"


@registry.add(
    "p3_found",
    f"""SELECT request_id AS custom_id FROM (SELECT {_ID} AS request_id FROM collected_requests)
    WHERE request_id <> '' GROUP BY request_id HAVING count(*) > 1""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers with more than one delivery."""
    once = once_per_id(table(spark, sf_dir, "collected_requests"), "custom_id", payload=False)
    return once.where("n_deliveries > 1").select(F.col("request_id").alias("custom_id"))


@registry.add(
    "p3_requests_once",
    f"""SELECT request_id, n_deliveries, batch_id, line_no::int AS line_no, method, url, body, collected_at, received_at FROM (
      SELECT *, {_ID} AS request_id, count(*) OVER (PARTITION BY {_ID})::bigint AS n_deliveries,
        row_number() OVER (PARTITION BY {_ID} ORDER BY coalesce(json_valid(body), false) DESC, received_at ASC NULLS LAST,
          collected_at ASC NULLS LAST, batch_id ASC NULLS LAST, line_no ASC NULLS LAST, md5(body) ASC NULLS LAST) AS rn
      FROM collected_requests) WHERE request_id <> '' AND rn = 1""",
)
def p3_requests_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole row per identifier: a complete body goes first, then the earliest arrival."""
    requests = table(spark, sf_dir, "collected_requests")
    order = [
        F.try_parse_json("body").isNull(),
        *(F.col(c) for c in ("received_at", "collected_at", "batch_id", "line_no")), F.md5("body"),
    ]
    once = once_per_id(requests, "custom_id", order)
    kept = [F.col("kept")[c].alias(c) for c in requests.columns if c != "custom_id"]
    return once.select("request_id", "n_deliveries", *kept)
