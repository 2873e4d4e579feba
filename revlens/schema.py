"""The fixed transaction schema, its defaults and the header alias dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    canonical: str        # header name the registry uses
    name: str             # our column name
    kind: str             # "str" | "numeric" | "datetime"
    default: object       # fill value (None: no default)
    critical: bool        # missing column -> error


# The 12-column registry (canonical header, default, critical),
# in registry order. Order ID's default is generated as AUTO-%06d (1-based).
REGISTRY: tuple[Field, ...] = (
    Field("Order ID", "order_id", "str", None, False),
    Field("Order Date", "order_date", "datetime", None, True),
    Field("Customer", "customer", "str", "Unknown Client", False),
    Field("Segment", "segment", "str", "General", False),
    Field("Region", "region", "str", "Global", False),
    Field("Product", "product", "str", "Standard Product", False),
    Field("Industry", "industry", "str", "Unknown", False),
    Field("License", "license", "str", "Standard", False),
    Field("Sales", "sales", "numeric", 0.0, True),
    Field("Quantity", "quantity", "numeric", 1.0, True),
    Field("Discount", "discount", "numeric", 0.0, False),
    Field("Profit", "profit", "numeric", 0.0, False),
)

ORDER_ID_FORMAT = "AUTO-%06d"
NULL_ORDER_ID = "Unknown"
DATE_KEY = Field("Date Key", "date_key", "numeric", None, False)

BY_CANONICAL = {f.canonical: f for f in REGISTRY}
BY_NAME = {f.name: f for f in REGISTRY}
CRITICAL = tuple(f for f in REGISTRY if f.critical)
CATEGORICAL = tuple(f for f in REGISTRY if f.kind == "str")
NUMERIC = tuple(f for f in REGISTRY if f.kind == "numeric")

# Header aliases (lookup key = lower(trim(header))) -> canonical.
HEADER_ALIASES: dict[str, tuple[str, ...]] = {
    "Order ID": ("order_id", "orderid", "order id", "order number", "order_number",
                 "ordernumber", "transaction_id", "transactionid", "transaction id",
                 "id", "invoice_id", "invoice id"),
    "Order Date": ("order_date", "orderdate", "order date", "date", "transaction_date",
                   "transactiondate", "transaction date", "purchase_date", "created_at",
                   "createdat", "created at", "timestamp"),
    "Customer": ("customer", "customer_name", "customername", "customer name", "client",
                 "client_name", "buyer", "contact_name", "contact name", "first_name",
                 "firstname", "first name", "name"),
    "Segment": ("segment", "customer_segment", "customersegment", "customer segment",
                "tier", "customer_tier", "account_type", "category"),
    "Region": ("region", "country", "customer_country", "customercountry",
               "customer country", "territory", "market", "geo", "geography", "location"),
    "Product": ("product", "product_name", "productname", "product name", "item",
                "item_name", "sku", "product_id"),
    "Sales": ("sales", "revenue", "total_revenue", "total revenue", "totalrevenue",
              "amount", "total_amount", "total amount", "total", "price", "total_price",
              "value", "deal_value", "order_total"),
    "Quantity": ("quantity", "qty", "units", "count", "items", "units_sold",
                 "quantity_sold", "order_quantity"),
    "Discount": ("discount", "discount_rate", "discountrate", "discount rate",
                 "discount_pct", "discount_percent", "disc"),
    "Profit": ("profit", "net_profit", "net profit", "margin", "gross_profit",
               "gross profit"),
    "Industry": ("industry", "sector", "vertical", "business_type", "business type"),
}

ALIAS_LOOKUP: dict[str, str] = {
    alias: canonical for canonical, aliases in HEADER_ALIASES.items() for alias in aliases
}

# Tokens a CSV reader treats as missing (pandas read_csv defaults).
NULL_TOKENS: tuple[str, ...] = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Clean transaction table produced by ingestion and by the fixture join.
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("order_date", T.TimestampType()),
    T.StructField("customer", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("industry", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("sales", T.DoubleType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("discount", T.DoubleType()),
    T.StructField("profit", T.DoubleType()),
])
