"""Column types and sentinel values shared by every stage."""

from pyspark.sql import types as T

# Strings that carry the meaning "missing" in a product record.
PRICE_UNAVAILABLE = "Price unavailable"
NO_RATING = "N/A"
NO_REVIEWS = "0 reviews"
NO_INGREDIENTS = "Not specified on main detail page"
UNKNOWN_AVAILABILITY = "Unknown"

SPECS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)

STRINGS = T.ArrayType(T.StringType())

PRODUCT = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("store_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("price_numeric", T.DoubleType()),
        T.StructField("currency", T.StringType()),
        T.StructField("original_price", T.StringType()),
        T.StructField("original_price_numeric", T.DoubleType()),
        T.StructField("discount_percentage", T.IntegerType()),
        T.StructField("rating", T.StringType()),
        T.StructField("rating_numeric", T.DoubleType()),
        T.StructField("review_count", T.StringType()),
        T.StructField("review_count_numeric", T.LongType()),
        T.StructField("availability", T.StringType()),
        T.StructField("social_proof", T.StringType()),
        T.StructField(
            "seller_info",
            T.StructType(
                [
                    T.StructField("seller", T.StringType()),
                    T.StructField("shipper", T.StringType()),
                    T.StructField("is_prime", T.BooleanType()),
                    T.StructField("return_policy", T.StringType()),
                ]
            ),
        ),
        T.StructField("breadcrumbs", STRINGS),
        T.StructField("image_url", T.StringType()),
        T.StructField("gallery_images", STRINGS),
        T.StructField("ingredients", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("aplus_content", T.StringType()),
        T.StructField("whats_in_the_box", STRINGS),
        T.StructField("directions", T.StringType()),
        T.StructField("safety_warning", T.StringType()),
        T.StructField("important_information", T.StringType()),
        T.StructField("bullet_points", STRINGS),
        T.StructField("specs", SPECS),
        T.StructField(
            "package_details",
            T.StructType(
                [
                    T.StructField("package_type", T.StringType()),
                    T.StructField("is_refill_only", T.BooleanType()),
                    T.StructField("device_included", T.BooleanType()),
                    T.StructField("requires_base_device", T.BooleanType()),
                    T.StructField("pack_quantity", T.StringType()),
                    T.StructField("net_volume_or_weight", T.StringType()),
                ]
            ),
        ),
        T.StructField("listing_integrity_alerts", STRINGS),
        T.StructField("url", T.StringType()),
    ]
)
