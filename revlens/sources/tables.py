"""Parquet table access and the fixture tables derived from the star schema.

``transactions`` is the clean transaction table every analytic operator
reads; ``raw_orders`` is its dirty, all-STRING twin that exercises the
ingestion rules; ``deals`` and ``fixed_clusters`` are derived inputs for the
deal-scoring and persona operators. All of them are lazy DataFrames: nothing
is read until an action runs, so filters and projections applied by callers
reach the Parquet scans.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dec(c, p: int, s: int):
    return F.col(c).cast(f"decimal({p},{s})") if isinstance(c, str) else c.cast(f"decimal({p},{s})")


def transactions(spark: SparkSession, sf_dir: str, *, exact: bool = True) -> DataFrame:
    """Star join lineitem-orders-customer-nation-region-part into one row per
    line item with the registry columns.

    ``sales``/``profit`` are DECIMAL when ``exact`` (sums are then exact and
    engine independent); downstream operators cast to DOUBLE before dividing.

    Plan: customer, nation, region and part are joined as the optimizer sees
    fit. Orders and lineitem are both facts: their join is a sort-merge join
    by hint, as the estimate for the compressed Parquet of the enriched orders
    may fall below the broadcast threshold while its rows don't fit the
    driver. Lineitem meets part first, whose columns are few and narrow: where
    part is too large for a broadcast, lineitem is shuffled twice, but never
    with the wide columns of orders and customers, which come last.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")

    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    cust = customer.join(geo, customer.c_nationkey == geo.n_nationkey).select(
        "c_custkey", "c_name", "c_mktsegment", "r_name")
    enriched_orders = orders.join(cust, orders.o_custkey == cust.c_custkey)
    with_part = li.join(part, li.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey")
    joined = with_part.join(enriched_orders.hint("merge"), with_part.l_orderkey == enriched_orders.o_orderkey)

    price = _dec("l_extendedprice", 12, 2)
    disc = _dec(F.col("l_discount") * 5, 4, 2)
    sales = (price * (F.lit(1) - disc)).cast("decimal(18,4)")
    cost_rate = F.lit(0.450).cast("decimal(4,3)") + F.lit(0.005).cast("decimal(4,3)") * F.col("p_size")
    profit = (sales - price * cost_rate).cast("decimal(20,5)")
    out = joined.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("o_orderdate").cast("timestamp").alias("order_date"),
        F.col("c_name").alias("customer"),
        F.col("c_mktsegment").alias("segment"),
        F.col("r_name").alias("region"),
        F.col("p_type").alias("product"),
        F.col("p_brand").alias("industry"),
        F.col("o_orderpriority").alias("license"),
        F.col("l_quantity").cast("double").alias("quantity"),
        (F.col("l_discount") * 5).alias("discount"),
        sales.alias("sales"),
        profit.alias("profit"),
    )
    if not exact:
        out = out.withColumn("sales", F.col("sales").cast("double")).withColumn(
            "profit", F.col("profit").cast("double"))
    return out


_RAW_FILES: dict = {}
#: Rows of a compressed file of the raw export: it is read by one task.
RAW_FILE_ROWS = 500_000


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty fixture as what it stands for - a raw CSV export: written
    once per session into the shared checkpoint directory, then read back
    with the CSV source (all columns STRING). Reading a file also keeps the
    optimizer from pushing the cleaning predicates into the star join. The
    files are compressed, as the text is most of what such a query writes."""
    from revlens.sources.files import read_csv
    return read_csv(spark, raw_orders_path(spark, sf_dir, "snappy"), sep=",", encoding="UTF-8")


def raw_orders_path(spark: SparkSession, sf_dir: str, compression: str = "none") -> str:
    """Where the raw export of this session lies."""
    from revlens.session import checkpoint_dir
    key = (id(spark._jsparkSession), sf_dir, compression)
    if key not in _RAW_FILES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/fixtures/raw_orders-{uuid.uuid4().hex}"
        rows = RAW_FILE_ROWS if compression != "none" else 0
        (raw_orders_frame(spark, sf_dir).write.mode("overwrite").option("header", True)
            .option("compression", compression).option("maxRecordsPerFile", rows)
            .option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        _RAW_FILES[key] = path
    return _RAW_FILES[key]


def raw_orders_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty, all-STRING variant of ``transactions`` with aliased headers,
    mixed date formats, currency text, percents, zeros and NULLs. The rule
    for each column is picked by ``k = l_orderkey * 10 + l_linenumber``."""
    tx = transactions(spark, sf_dir)
    k = F.col("order_id").cast("bigint") * 10 + F.col("line_number")

    def rule(*pairs, otherwise):
        expr = None
        for mod, value in pairs:
            cond = (k % mod) == 0
            expr = F.when(cond, value) if expr is None else expr.when(cond, value)
        return expr.otherwise(otherwise)

    null = F.lit(None).cast("string")
    d = F.col("order_date")
    date_text = (F.when(k % 61 == 0, F.lit("not a date"))
                 .when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd"))
                 .when(k % 3 == 1, F.date_format(d, "yyyy/MM/dd"))
                 .otherwise(F.date_format(d, "M/d/yyyy")))
    disc_text = F.col("discount").cast("decimal(4,2)").cast("string")
    return tx.select(
        rule((47, null), otherwise=F.col("order_id")).alias(" order_id "),
        date_text.alias("Date"),
        rule((43, null), otherwise=F.col("customer")).alias("Client"),
        rule((59, null), otherwise=F.col("segment")).alias("Tier"),
        rule((53, null), otherwise=F.col("region")).alias("Country"),
        F.col("product").alias("SKU"),
        rule((97, F.lit("n/a")), (89, F.lit("0")), (83, F.lit("-12.50")),
             otherwise=F.concat(F.lit("$"), F.col("sales").cast("string"))).alias("Amount"),
        rule((79, F.lit("0")), (73, null),
             otherwise=F.col("quantity").cast("int").cast("string")).alias("Qty"),
        rule((71, F.lit("45%")), (67, null), otherwise=disc_text).alias("Discount Rate"),
        rule((41, null), otherwise=F.col("profit").cast("string")).alias("net_profit"),
        F.col("industry").alias("Sector"),
    )


def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deals to score: every line item of ``transactions`` in the deal schema
    (segment, region, industry, product, quantity, sales, discount)."""
    return deals_of(transactions(spark, sf_dir))


def deals_of(tx: DataFrame) -> DataFrame:
    """``deals`` of transactions that are already at hand."""
    return tx.select(
        F.concat_ws("-", F.col("order_id"), F.col("line_number").cast("string")).alias("deal_id"),
        "segment", "region", "industry", "product",
        F.col("quantity").cast("int").alias("quantity"),
        F.col("sales").cast("double").alias("sales"),
        F.col("discount").cast("double").alias("discount"),
    )


def fixed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic stand-in for k-means output: cluster = c_custkey % 4,
    keyed by customer name so it joins to ``transactions``."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return cust.select(F.col("c_name").alias("customer"),
                       (F.col("c_custkey") % 4).cast("int").alias("cluster"))
