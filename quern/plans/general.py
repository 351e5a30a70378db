"""Queries of the general large-scale operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import NotFoundError
from quern.operators.balanced import exchange_counts, heavy_keys, key_text
from quern.operators.orphans import References, find_orphans, orphan_report
from quern.sources.files import read_parquet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _exchange_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(name: str) -> DataFrame | None:
        try:
            return table(spark, sf_dir, name)
        except NotFoundError:
            return None

    return exchange_counts(spark, table(spark, sf_dir, "hash_exchanges"), named)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_exchange_counts(spark, sf_dir)).select("exchange_id", "key_text")


def p1_heavy_key_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = heavy_keys(_exchange_counts(spark, sf_dir))
    return found.select("exchange_id", "key_text", "n", F.round("total", 2).alias("total"))


def p1_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key of every exchange."""
    found = _exchange_counts(spark, sf_dir)
    return found.select("exchange_id", key_text(F.col("key")).alias("key_text"), "n", F.round("total", 2).alias("total"))


#: Columns of the tables that hash_exchanges may name, in file order; key_columns are positions in them.
COLUMNS = {
    "sales": ["id", "region", "customer_id", "amount", "active", "sold_at", "loaded_at"],
    "shop_orders": ["order_id", "customer_id", "amount", "ordered_at", "loaded_at"],
    "customers": ["customer_id", "name", "tier", "created_at", "deleted_at"],
    "keyed": ["row_id", "category", "code", "amount"],
}


def _exchange_sql() -> str:
    """Keys and counts of whatever exchanges the table hash_exchanges has."""
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS input_table, [{', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}] AS texts, {'amount' if 'amount' in columns else 'NULL::DOUBLE AS amount'} FROM {name}"
        for name, columns in COLUMNS.items()
    )
    key = "array_to_string([coalesce(texts[p + 1], 'null') for p in key_columns], '|')"
    return f"SELECT exchange_id, {key} AS key_text, count(*) AS n, round(sum(amount), 2) AS total FROM ({rows}) JOIN hash_exchanges USING (input_table) GROUP BY ALL"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = [
        References("sales", table(spark, sf_dir, "sales"), "id", "customer_id", "sold_at"),
        References("shop_orders", table(spark, sf_dir, "shop_orders"), "order_id", "customer_id", "ordered_at"),
    ]
    return find_orphans(references, table(spark, sf_dir, "customers"), "customer_id", "created_at", "deleted_at")


def p3_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p3_found(spark, sf_dir))


_ORPHANS = " UNION ".join(
    f"""SELECT '{name}' AS table_name, strftime(r.{time}, '%Y-%m') AS year_month, r.{record} AS record_id FROM {name} r
    WHERE r.customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customers c WHERE c.customer_id = r.customer_id
    AND c.created_at <= r.{time} AND (c.deleted_at IS NULL OR c.deleted_at > r.{time}))"""
    for name, record, time in (("sales", "id", "sold_at"), ("shop_orders", "order_id", "ordered_at"))
)

QUERIES = {
    "p1_found": p1_found,
    "p1_heavy_key_sums": p1_heavy_key_sums,
    "p1_key_counts": p1_key_counts,
    "p3_found": p3_found,
    "p3_orphans_by_month": p3_orphans_by_month,
}

SQL = {
    "p1_found": f"WITH c AS ({_exchange_sql()}) SELECT exchange_id, key_text FROM c QUALIFY 50 * n >= sum(n) OVER (PARTITION BY exchange_id)",
    "p1_heavy_key_sums": f"WITH c AS ({_exchange_sql()}) SELECT * FROM c QUALIFY 50 * n >= sum(n) OVER (PARTITION BY exchange_id)",
    "p1_key_counts": _exchange_sql(),
    "p3_found": _ORPHANS,
    "p3_orphans_by_month": f"SELECT table_name, year_month, count(*) AS orphans FROM ({_ORPHANS}) GROUP BY table_name, year_month",
}
