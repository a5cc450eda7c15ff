"""Transfers derived from order data.

Each order acts as an escrow account: the customer pays it, it pays suppliers line by
line, suppliers refund returned lines, some orders are cancelled back, and some
customers move money to themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrail.functions.columns import node_id
from flowtrail.functions.skew import shuffled
from flowtrail.params import PATTERN_TYPES

# Currency by region key, rail by order priority digit.
CURRENCIES = ("US Dollar", "Euro", "Yuan", "Yen", "Rupee")
RAILS = ("ACH", "ACH", "Cheque", "Wire", "Credit Card")
ORIGIN = "2022-09-01 00:00:00"
BANK_DIGITS = 3


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _money(col) -> F.Column:
    return col.cast("decimal(18,2)")


def _at(minutes) -> F.Column:
    return F.expr(f"timestamp_ntz'{ORIGIN}'") + F.make_dt_interval(mins=minutes.cast("int"))


def _bank(nation_key: str) -> F.Column:
    return F.lpad(F.col(nation_key).cast("string"), BANK_DIGITS, "0")


def with_parts(transfers: DataFrame) -> DataFrame:
    """Add banks, accounts and the amount received, which follow from what ``derive_transfers`` gives and need not be stored."""
    parts = {}
    for end in ("from", "to"):
        parts[f"{end}_bank"] = F.substring(f"{end}_node", 1, BANK_DIGITS)
        parts[f"{end}_account"] = F.expr(f"substring({end}_node, {BANK_DIGITS + 2})")
    return transfers.withColumns({**parts, "amount_received": F.col("amount_paid")})


def derive_transfers(spark: SparkSession, folder: str) -> DataFrame:
    nation = F.broadcast(_read(spark, folder, "nation").select("n_nationkey", "n_regionkey"))
    customer = (
        _read(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", _bank("c_nationkey").alias("c_bank"), F.col("n_regionkey").alias("c_region"))
    )
    supplier = (
        _read(spark, folder, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", _bank("s_nationkey").alias("s_bank"), F.col("n_regionkey").alias("s_region"),
                F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("s_account"))
    )
    key = F.col("o_orderkey")
    orders = (
        _read(spark, folder, "orders")
        .join(shuffled(customer), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            "o_orderkey",
            "o_totalprice",
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
            "c_bank",
            "c_region",
            F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("c_account"),
            F.concat(F.lit("O"), key.cast("string")).alias("o_account"),
            ((key * 1009) % 11520).alias("m0"),
        )
    )
    price = F.col("o_totalprice").cast("decimal(18,2)")
    ten = _money(price * F.lit(10))
    m0, leg = F.col("m0"), F.col("leg")
    # Only the names of an order's transfers are exploded; a filtered array of whole transfers is not compiled.
    order_legs = orders.select(
        "*", F.explode(F.array(F.lit("pay"), F.when(key % 7 == 0, "cancel"), F.when(key % 9 == 0, "self"))).alias("leg")
    ).where(leg.isNotNull())
    customer_node, escrow_node = node_id("c_bank", "c_account"), node_id("c_bank", "o_account")
    none = F.lit(None)
    order_legs = order_legs.select(
        "o_orderkey",
        "priority",
        "leg",
        none.cast("int").alias("linenumber"),
        none.cast("bigint").alias("partkey"),
        none.cast("bigint").alias("suppkey"),
        (m0 + F.when(leg == "cancel", 360).when(leg == "self", 30).otherwise(0)).cast("bigint").alias("minutes"),
        F.when(leg == "cancel", escrow_node).otherwise(customer_node).alias("from_node"),
        F.when(leg == "pay", escrow_node).otherwise(customer_node).alias("to_node"),
        F.when(leg == "cancel", _money(F.round(price * F.lit(9.5).cast("decimal(3,1)"), 2))).otherwise(ten).cast("double").alias("amount_paid"),
        F.col("c_region").alias("src_region"),
        F.col("c_region").alias("dst_region"),
    )
    lines = (
        _read(spark, folder, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
        .join(shuffled(supplier), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(shuffled(orders), F.col("l_orderkey") == key)
    )
    line_amount = _money(F.col("l_extendedprice").cast("decimal(18,2)") * F.lit(10))
    line_at = m0 + F.col("l_linenumber") * 45
    # Refunds run in a nightly batch from 02:00 on the day after the line.
    refund_at = (F.floor(line_at / 1440) + 1) * 1440 + 120 + key % 60
    vendor_node = node_id("s_bank", "s_account")
    is_line = leg == "line"
    line_legs = lines.select(
        "*", F.explode(F.array(F.lit("line"), F.when(F.col("l_returnflag") == "R", "refund"))).alias("leg")
    ).where(leg.isNotNull()).select(
        "o_orderkey",
        "priority",
        "leg",
        F.col("l_linenumber").cast("int").alias("linenumber"),
        F.col("l_partkey").cast("bigint").alias("partkey"),
        F.col("l_suppkey").cast("bigint").alias("suppkey"),
        F.when(is_line, line_at).otherwise(refund_at).cast("bigint").alias("minutes"),
        F.when(is_line, escrow_node).otherwise(vendor_node).alias("from_node"),
        F.when(is_line, vendor_node).otherwise(customer_node).alias("to_node"),
        line_amount.cast("double").alias("amount_paid"),
        F.when(is_line, F.col("c_region")).otherwise(F.col("s_region")).alias("src_region"),
        F.when(is_line, F.col("s_region")).otherwise(F.col("c_region")).alias("dst_region"),
    )
    block = F.floor(key / 194)
    in_ring = (key % 194 == 0) & (F.col("leg") != "self") & ((block % 8 != 0) | (F.col("leg") == "pay"))
    ring = F.when(in_ring, block + 1)
    return (
        order_legs.unionByName(line_legs)
        .select(
            "leg",
            F.col("o_orderkey").alias("orderkey"),
            "linenumber",
            "partkey",
            "suppkey",
            _at(F.col("minutes")).alias("timestamp"),
            "from_node",
            "to_node",
            _pick(CURRENCIES, F.col("dst_region")).alias("receiving_currency"),
            "amount_paid",
            _pick(CURRENCIES, F.col("src_region")).alias("payment_currency"),
            _pick(RAILS, F.col("priority") - 1).alias("payment_format"),
            (key % 97 == 0).cast("int").alias("is_laundering"),
            ring.cast("bigint").alias("ring_id"),
            F.when(ring.isNotNull(), _pick(PATTERN_TYPES, ring % 8)).alias("pattern_type"),
        )
    )
