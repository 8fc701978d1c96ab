"""Marketplace listings and shop products announced in event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hexnum import content_hash, hex_to_text
from ..functions.text import data_directory

# Event topics, contract addresses and first blocks of the two
# marketplace versions, and defaults of the off-chain documents.
LISTING_TOPICS = [
    "0xec3d306143145322b45d2788d826e3b7b9ad062f16e1ec59a5eaba214f96ee3c",
    "0x470503ad37642fff73a57bac35e69733b6b38281a893f39b50c285aad1f040e0",
]
MARKET_V0 = ("000", "0x819bb9964b6ebf52361f1ae42cf4831b921510f9", 6436157)
MARKET_V1 = ("001", "0x698ff47b84837d3971118a369c570172ee7e54c2", 8582597)
NETWORK_ID = "1"
DEFAULT_CURRENCY = "fiat-USD"


def listing_events(logs: DataFrame) -> DataFrame:
    """Listing events with their id and content hash.

    The contract address decides the version, but only inside that version's block
    epoch. The listing number is the third topic, so three topics are required.
    """
    v0, v1 = MARKET_V0, MARKET_V1
    block = F.col("block_number")
    version = F.when(
        (F.lower("address") == v0[1]) & (block >= v0[2]) & (block < v1[2]), F.lit(v0[0])
    ).when((F.lower("address") == v1[1]) & (block >= v1[2]), F.lit(v1[0]))
    return (
        logs.filter(F.get("topics", F.lit(0)).isin(LISTING_TOPICS) & (F.size("topics") >= 3))
        .withColumn("_version", version)
        .filter("_version IS NOT NULL")
        .select(
            F.concat_ws("-", F.lit(NETWORK_ID), "_version", hex_to_text(F.get("topics", F.lit(2)))).alias("listing_id"),
            content_hash(F.col("data")).alias("ipfs_hash"),
            "block_number",
            "log_index",
        )
    )


def _text(name: str) -> Column:
    return F.coalesce(F.get_json_object("body", f"$.{name}"), F.lit(""))


def marketplace_listings(logs: DataFrame, documents: DataFrame) -> DataFrame:
    """Listing events joined to their off-chain ``documents(path, body)``."""
    docs = documents.withColumnRenamed("path", "ipfs_hash")
    return listing_events(logs).join(docs, "ipfs_hash").select(
        "listing_id",
        "ipfs_hash",
        _text("listingType").alias("listing_type"),
        _text("category").alias("category"),
        _text("subCategory").alias("subcategory"),
        _text("language").alias("language"),
        _text("title").alias("title"),
        _text("description").alias("description"),
        _text("price.amount").alias("price"),
        _text("price.currency").alias("currency"),
        "block_number",
        "log_index",
    )


_VARIANT = "id:string,externalId:string,title:string,price:bigint,option1:string,option2:string,option3:string,image:string"
_PRODUCT = (
    "struct<externalId:string,title:string,description:string,price:bigint,currency:string,"
    f"image:string,variants:array<struct<{_VARIANT}>>>"
)


def shop_products(logs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per shop product and one per variant.

    Path steps are joins on the documents table: listing, shop index page, product
    list, product detail. Products without an id or a detail document are skipped.
    """
    docs = documents.select("path", "body")
    shops = (
        listing_events(logs).join(docs, F.col("ipfs_hash") == F.col("path"))
        .withColumn("_shop", F.get_json_object("body", "$.shopIpfsHash"))
        .filter(F.col("_shop") != "")
        .select("listing_id", "block_number", "log_index", "_shop")
    )
    pages = docs.select(F.col("path").alias("_page"), F.col("body").alias("_html"))
    base = shops.join(pages, F.concat("_shop", F.lit("/index.html")) == F.col("_page")).withColumn(
        "_base", F.concat_ws("/", "_shop", data_directory(F.col("_html")))
    ).drop("_page", "_html")
    lists = docs.select(F.col("path").alias("_list"), F.from_json("body", "array<struct<id:string>>").alias("_items"))
    products = (
        base.join(lists, F.concat("_base", F.lit("/products.json")) == F.col("_list"))
        .withColumn("_id", F.explode("_items.id"))
        .filter(F.col("_id") != "")
        .withColumn("ipfs_path", F.concat_ws("/", "_base", "_id"))
        .drop("_list", "_items", "_base", "_shop")
    )
    details = docs.select(F.col("path").alias("_detail"), F.from_json("body", _PRODUCT).alias("p"))
    full = products.join(details, F.concat("ipfs_path", F.lit("/data.json")) == F.col("_detail")).drop("_detail")

    no_text = F.lit(None).cast("string")
    external = F.when(F.col("p.externalId") != "", F.col("p.externalId"))
    currency = F.coalesce("p.currency", F.lit(DEFAULT_CURRENCY)).alias("currency")

    def row(item: str, item_id: Column, ext: Column, parent: Column, options: list[Column]) -> list[Column]:
        return [
            F.col("listing_id"),
            F.concat_ws("-", "listing_id", item_id).alias("product_id"),
            F.col("ipfs_path"),
            ext.alias("external_id"),
            parent.alias("parent_external_id"),
            F.col(f"{item}.title").alias("title"),
            F.col("p.description").alias("description"),
            F.col(f"{item}.price").alias("price"),
            currency,
            *[o.alias(f"option{i}") for i, o in enumerate(options, 1)],
            F.col(f"{item}.image").alias("image"),
            F.col("block_number"),
            F.col("log_index"),
        ]

    tops = full.select(*row("p", F.col("_id"), external, no_text, [no_text] * 3))
    variants = full.withColumn("v", F.explode("p.variants")).select(*row(
        "v", F.col("v.id"), F.when(F.col("v.externalId") != "", F.col("v.externalId")), external,
        [F.col(f"v.option{i}") for i in (1, 2, 3)],
    ))
    return tops.unionByName(variants)
