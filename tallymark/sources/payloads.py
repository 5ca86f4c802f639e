"""Shop payloads on disk to one product schema. Each adapter takes rows with the raw payload and store_slug."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRODUCT = ("store_slug", "external_url", "external_sku", "name", "brand", "image_url", "price_ars", "currency", "in_stock", "description")


def product(**columns: Column) -> list[Column]:
    """The product schema; what a platform doesn't say is null."""
    kinds = {"price_ars": "double", "in_stock": "boolean"}
    given = {"currency": F.lit("ARS"), "in_stock": F.lit(False)} | columns
    return [given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in PRODUCT]


def at(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def first_of(doc: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(at(doc, p)), F.lit("")) for p in paths])


def number(x: Column) -> Column:
    """The amount in a price text, if it is above 0."""
    n = F.regexp_replace(x, "[^0-9.]", "").try_cast("double")
    return F.when(n > 0, n)


def gtin(*candidates: Column) -> Column:
    """The first candidate of 8 to 14 digits, spaces and hyphens aside."""
    clean = [F.regexp_replace(c, r"[\s-]", "") for c in candidates]
    return F.coalesce(*[F.when(c.rlike("^[0-9]{8,14}$"), c) for c in clean])


def at_least(price: Column, least: float) -> Column:
    return F.when(price >= least, price)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON from a path, or no rows where nothing is there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def json_ld_products(pages: DataFrame) -> DataFrame:
    """Products of JSON-LD blocks (html, store_slug): objects, arrays and mainEntity; broken blocks are passed over."""
    blocks = pages.select("store_slug", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*type=["\']?application/ld\+json["\']?[^>]*>(.*?)</script>'), F.lit(1))).alias("raw"))
    one = F.when(F.trim("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.array(F.trim("raw")))
    docs = blocks.select("store_slug", F.explode(one).alias("outer"))
    inner = F.array_compact(F.array(F.col("outer"), at(F.col("outer"), "$.mainEntity")))
    docs = docs.select("store_slug", F.explode(inner).alias("doc"))
    doc = F.col("doc")
    kind = at(doc, "$['@type']")
    docs = docs.where((kind == "Product") | kind.rlike('^\\[.*"Product".*\\]$'))
    offer = F.coalesce(at(doc, "$.offers[0]"), at(doc, "$.offers"))
    image = F.coalesce(at(doc, "$.image[0]"), at(doc, "$.image.url"), at(doc, "$.image"))
    sku = gtin(*[at(doc, f"$.{k}") for k in ("gtin13", "gtin14", "gtin12", "gtin8", "gtin", "sku")])
    return docs.select(*product(
        store_slug=F.col("store_slug"), external_url=first_of(doc, "$.mainEntityOfPage['@id']", "$['@id']"), external_sku=F.coalesce(sku, at(doc, "$.sku")), name=at(doc, "$.name"),
        brand=F.coalesce(at(doc, "$.brand.name"), at(doc, "$.brand")), image_url=image, price_ars=number(F.coalesce(at(offer, "$.price"), at(offer, "$.lowPrice"))),
        currency=F.coalesce(at(offer, "$.priceCurrency"), F.lit("ARS")), in_stock=F.coalesce(at(offer, "$.availability").rlike("(?i)InStock"), F.lit(False)), description=at(doc, "$.description"),
    ))


def woocommerce(rows: DataFrame) -> DataFrame:
    """Store API items (payload): brand from brands, else a brand attribute; prices in minor units."""
    doc = F.col("payload")
    attributes = F.from_json(at(doc, "$.attributes"), "array<struct<taxonomy:string,terms:array<struct<name:string>>>>")
    own = F.get(F.filter(attributes, lambda a: F.lower(a["taxonomy"]).rlike("bodega|brand|pa_marca")), F.lit(0))
    minor = F.coalesce(at(doc, "$.prices.currency_minor_unit").try_cast("int"), F.lit(2))
    price = at(doc, "$.prices.price").try_cast("double") / F.pow(F.lit(10.0), minor)
    text = F.trim(F.regexp_replace(F.regexp_replace(at(doc, "$.short_description"), "<[^>]*>", " "), r"\s+", " "))
    sku = at(doc, "$.sku")
    return rows.select(*product(store_slug=F.col("store_slug"), external_url=at(doc, "$.permalink"), external_sku=F.coalesce(gtin(at(doc, "$.gtin"), sku), sku), name=at(doc, "$.name"), brand=F.coalesce(at(doc, "$.brands[0].name"), F.get(own["terms"], F.lit(0))["name"]), image_url=at(doc, "$.images[0].src"), price_ars=F.when(price > 0, price), in_stock=F.coalesce(at(doc, "$.is_in_stock") == "true", F.lit(False)), description=text))


def vtex(rows: DataFrame, least: float = 1500) -> DataFrame:
    """Catalogue items: the first item and seller; prices below `least` are placeholders."""
    doc = F.col("payload")
    item = lambda p: at(doc, f"$.items[0].{p}")
    offer = lambda p: item(f"sellers[0].commertialOffer.{p}")
    price = F.coalesce(*[F.when(offer(p).try_cast("double") > 0, offer(p).try_cast("double")) for p in ("Price", "ListPrice", "PriceWithoutDiscount")])
    stock = (F.coalesce(offer("IsAvailable") == "true", F.lit(False))) | (F.coalesce(offer("AvailableQuantity").try_cast("int"), F.lit(0)) > 0)
    return rows.select(*product(store_slug=F.col("store_slug"), external_url=at(doc, "$.link"), external_sku=F.coalesce(F.nullif(item("ean"), F.lit("")), item("itemId"), at(doc, "$.productReference")), name=at(doc, "$.productName"), brand=at(doc, "$.brand"), image_url=item("images[0].imageUrl"), price_ars=at_least(price, least), in_stock=stock, description=at(doc, "$.description")))


def shopify(rows: DataFrame, least: float = 500) -> DataFrame:
    """Products (payload, store_slug, store_name): variant 0; the vendor is the brand unless it is the shop."""
    doc = F.col("payload")
    tags = F.coalesce(F.from_json(at(doc, "$.tags"), "array<string>"), F.split(at(doc, "$.tags"), r",\s*"))
    tag = F.get(F.filter(tags, lambda t: F.lower(t).rlike("^(?:marca|bodega):")), F.lit(0))
    vendor = at(doc, "$.vendor")
    brand = F.when(F.lower(vendor) != F.lower("store_name"), vendor).otherwise(F.nullif(F.trim(F.regexp_replace(tag, "(?i)^(?:marca|bodega):", "")), F.lit("")))
    barcode, sku = at(doc, "$.variants[0].barcode"), at(doc, "$.variants[0].sku")
    ean = F.coalesce(*[F.when(x.rlike("^[0-9]{12,14}$"), x) for x in (barcode, sku)], sku)
    price = at_least(at(doc, "$.variants[0].price").try_cast("double"), least)
    stock = F.coalesce(at(doc, "$.variants[0].available") == "true", F.lit(False)) & price.isNotNull()
    return rows.select(*product(store_slug=F.col("store_slug"), external_url=F.concat(F.lit("/products/"), at(doc, "$.handle")), external_sku=ean, name=at(doc, "$.title"), brand=brand, image_url=at(doc, "$.images[0].src"), price_ars=price, in_stock=stock, description=at(doc, "$.body_html")))


def cards(pages: DataFrame, mark: str, fields: dict[str, str], least: float = 500) -> DataFrame:
    """HTML listing cards (html, store_slug): the page is cut at `mark`, and each field is a pattern's first group.

    `fields` has patterns for external_url, name, price_ars and, where the platform says it, external_sku, brand and image_url.
    """
    parts = pages.select("store_slug", F.explode(F.slice(F.split("html", mark), 2, 1_000_000)).alias("card"))
    said = {k: F.nullif(F.trim(F.regexp_extract("card", p, 1)), F.lit("")) for k, p in fields.items()}
    amount = F.regexp_replace(F.regexp_replace(F.regexp_replace(said["price_ars"], r"[^0-9.,]", ""), r"\.(?=[0-9]{3}(?:[^0-9]|$))", ""), ",", ".").try_cast("double")
    price = at_least(F.round(amount), least)
    rest = {k: c for k, c in said.items() if k != "price_ars"}
    rest["external_url"] = F.regexp_replace(rest["external_url"], r"[?#].*$", "")
    return parts.select(*product(store_slug=F.col("store_slug"), price_ars=price, in_stock=price.isNotNull(), **rest)).where(F.col("name").isNotNull() & F.col("external_url").isNotNull())


MAGENTO = {"external_url": r'product-item-link"[^>]*href="([^"]*)"', "name": r'product-item-link"[^>]*>\s*([^<]*)<', "price_ars": r'data-price-amount="([^"]*)"', "image_url": r'<img[^>]*src="([^"]*)"'}
PRESTASHOP = {"external_url": r'product-title"><a href="([^"]*)"', "name": r'product-title"><a[^>]*>([^<]*)<', "price_ars": r'class="price"[^>]*>([^<]*)<', "external_sku": r'data-reference="([^"]*)"', "image_url": r'<img[^>]*src="([^"]*)"'}
MARKETPLACE = {"external_url": r'href="([^"]*)"', "name": r'poly-component__title"?[^>]*>([^<]*)<', "price_ars": r'(?s)poly-price__current.*?fraction"?[^>]*>([^<]*)<', "external_sku": r"(ML[AU]-?[0-9]+)", "image_url": r'<img[^>]*src="([^"]*)"'}


def discounted(rows: DataFrame, keep: tuple[str, ...] = ("vinos", "espumantes")) -> DataFrame:
    """A custom shop: only some top categories; prices less a percentage, rounded."""
    doc = F.col("payload")
    price = F.round(at(doc, "$.price").try_cast("double") * (1 - F.coalesce(at(doc, "$.discount").try_cast("double"), F.lit(0.0)) / 100))
    rows = rows.where(F.lower(at(doc, "$.topCat")).isin(*keep))
    return rows.select(*product(store_slug=F.col("store_slug"), external_url=at(doc, "$.url"), external_sku=at(doc, "$.sku"), name=at(doc, "$.name"), brand=at(doc, "$.brand"), image_url=at(doc, "$.image"), price_ars=F.when(price > 0, price), in_stock=F.coalesce(at(doc, "$.stock").try_cast("double") > 0, F.lit(False))))


def enrich(products: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue facts (external_sku, c_name, c_brand, c_sku, varietal, year, volume, type) over a listing's own; the description joins what is there."""
    facts = F.nullif(F.concat_ws(" · ", "varietal", F.col("year").cast("string"), "volume", F.when(F.col("varietal").isNull(), F.col("type"))), F.lit(""))
    rows = products.join(catalogue, "external_sku", "left")
    new = {"name": F.coalesce("c_name", "name"), "brand": F.coalesce("c_brand", "brand"), "external_sku": F.coalesce("c_sku", "external_sku"), "description": F.coalesce(facts, "description")}
    return rows.select(*[new.get(c, F.col(c)).alias(c) for c in products.columns])


#: Marks by which a shop platform is told, in order.
PLATFORM_MARKS = [("tiendanube", r"(?i)tiendanube|nuvemshop|cdn-us\.mitiendanube"), ("vtex", r"(?i)vtexassets|vtex\.com|__RUNTIME__"), ("shopify", r"(?i)cdn\.shopify|Shopify\.theme"), ("woocommerce", r"(?i)woocommerce|wp-content/plugins/woo"), ("magento", r"(?i)Magento_|mage/cookies"), ("prestashop", r"(?i)prestashop")]


def detect_platform(html: Column) -> Column:
    """The first platform whose mark a page shows."""
    return F.coalesce(*[F.when(html.rlike(p), F.lit(name)) for name, p in PLATFORM_MARKS], F.lit("unknown"))


def crawl_results(products: DataFrame) -> DataFrame:
    """One row per store and URL, the first seen (`seen_at`, then the row's values)."""
    from pyspark.sql import Window

    w = Window.partitionBy("store_slug", "external_url").orderBy("seen_at", "name", "price_ars")
    return products.withColumn("__tm_n", F.row_number().over(w)).where("__tm_n = 1").drop("__tm_n")


def store_counts(products: DataFrame, errors: DataFrame) -> DataFrame:
    """store_slug, product_count, errors (a count) of a crawl's results and its errors (store_slug, message); stores with errors alone have no product."""
    counts = products.groupBy("store_slug").agg(F.count("*").alias("product_count"))
    failed = errors.groupBy("store_slug").agg(F.count("*").alias("errors"))
    return counts.join(failed, "store_slug", "full").select("store_slug", F.coalesce("product_count", F.lit(0)).alias("product_count"), F.coalesce("errors", F.lit(0)).alias("errors"))
