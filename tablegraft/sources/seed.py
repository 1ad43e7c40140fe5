"""Five tables of payments with planted violations, from row numbers alone. Moments and amounts are functions of the row number,
so that a seed gives the same rows wherever it is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZES = {"txns": 25_000_000, "accounts": 200_000, "merchants": 20_000, "cards": 400_000, "disputes": 500_000}
COUNTRIES = ("US", "GB", "DE", "FR", "IN", "BR", "JP", "CA")
CATEGORIES = ("retail", "travel", "food", "software", "health")
BRANDS = ("visa", "mastercard", "amex", "discover")
NOW = "2025-01-01 00:00:00"


def _pick(values: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("g") % len(values) + 1).cast("int"))


def _ago(seconds) -> F.Column:
    return (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(secs=seconds)).cast("timestamp_ntz")


def _base(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).withColumnRenamed("id", "g")


def merchants(spark: SparkSession, n: int = SIZES["merchants"]) -> DataFrame:
    """Every 100th website is null."""
    g = F.col("g")
    return _base(spark, n).select(
        g.alias("id"), F.concat(F.lit("Merchant "), g).alias("name"), _pick(CATEGORIES).alias("category"), _pick(COUNTRIES).alias("country"),
        F.when(g % 100 != 0, F.concat(F.lit("https://m"), g, F.lit(".example"))).alias("website"), _ago(g * 60).alias("created_at"),
    )


def accounts(spark: SparkSession, n: int = SIZES["accounts"]) -> DataFrame:
    """Every 500th email is shared by two, every 97th other one is null."""
    g = F.col("g")
    email = F.when(g % 500 == 0, F.concat(F.lit("dupe_"), F.floor(g / 1000), F.lit("@example.com"))).when(g % 97 != 0, F.concat(F.lit("user"), g, F.lit("@example.com")))
    return _base(spark, n).select(g.alias("id"), F.concat(F.lit("Account "), g).alias("name"), email.alias("email"), _pick(COUNTRIES).alias("country"), _ago(g * 30).alias("created_at"))


def cards(spark: SparkSession, n: int = SIZES["cards"], accounts: int = SIZES["accounts"]) -> DataFrame:
    """Every 200th fingerprint is shared by two."""
    g = F.col("g")
    fingerprint = F.when(g % 200 == 0, F.concat(F.lit("fp_dupe_"), F.floor(g / 400))).otherwise(F.md5(g.cast("string").cast("binary")))
    return _base(spark, n).select(
        g.alias("id"), (g % accounts + 1).alias("account_id"), F.lpad((g % 10000).cast("string"), 4, "0").alias("last4"), _pick(BRANDS).alias("brand"),
        (g % 12 + 1).cast("short").alias("exp_month"), (g % 8 + 2025).cast("short").alias("exp_year"),
        F.when(g % 20 == 0, "blocked").otherwise("active").alias("status"), fingerprint.alias("fingerprint"), _ago(g * 45).alias("created_at"),
    )


def txns(spark: SparkSession, n: int = SIZES["txns"], accounts: int = SIZES["accounts"]) -> DataFrame:
    """Every 50th memo is null."""
    g = F.col("g")
    return _base(spark, n).select(
        g.alias("id"), (g % accounts + 1).alias("account_id"), (F.pmod(F.xxhash64("g"), F.lit(500_000)) + 1).alias("amount_cents"), F.when(g % 5 == 0, "EUR").otherwise("USD").alias("currency"),
        F.when(g % 40 == 0, "failed").otherwise("settled").alias("status"), F.when(g % 50 != 0, F.concat(F.lit("memo "), g)).alias("memo"), _ago(g).alias("created_at"),
    )


def disputes(spark: SparkSession, n: int = SIZES["disputes"], txns: int = SIZES["txns"], accounts: int = SIZES["accounts"], merchants: int = SIZES["merchants"]) -> DataFrame:
    """Every 33rd reason is null; two of three are resolved."""
    g = F.col("g")
    return _base(spark, n).select(
        g.alias("id"), (g % txns + 1).alias("txn_id"), (g % accounts + 1).alias("account_id"), (g % merchants + 1).alias("merchant_id"),
        F.when(g % 33 != 0, F.concat(F.lit("reason "), g % 7)).alias("reason"), F.when(g % 3 == 0, "open").otherwise("closed").alias("status"),
        (g % 100_000 + 1).alias("amount_cents"), _ago(g * 20).alias("opened_at"), F.when(g % 3 != 0, _ago(g * 10)).alias("resolved_at"),
    )


MAKERS = {"merchants": merchants, "accounts": accounts, "cards": cards, "txns": txns, "disputes": disputes}
KEYS = dict.fromkeys(MAKERS, ["id"])


def seed(spark: SparkSession, root: str, sizes: dict[str, int] | None = None, missing_only: bool = False) -> dict[str, str]:
    """Writes the tables as parquet below root; with missing_only those that aren't there. Returns their paths."""
    from .files import Files

    files, out = Files(spark, root), {}
    for name, make in MAKERS.items():
        out[name] = files.path(name)
        if not (missing_only and files.size(out[name])):
            make(spark, (sizes or SIZES).get(name, SIZES[name])).write.mode("overwrite").parquet(out[name])
    return out
