import pytest
from pyspark.sql import functions as F

from offerlens.operators import classify as C

SCHEMA = (
    "title string, description string, bullet_points array<string>, aplus_content string, "
    "specs array<struct<key:string,value:string>>"
)


def analyse(spark, title, description="", bullets=(), specs=(), rich=""):
    df = spark.createDataFrame([(title, description, list(bullets), rich, list(specs))], SCHEMA)
    return C.classify(df).first()


def kind(row):
    return row.package_details.package_type


def test_refill_with_claims(spark):
    row = analyse(
        spark,
        "Raid, Electric Unit, Odourless, Mosquito Killer, Liquid Refill, Twin Pack, 2 x 33 ml",
        "The unit plugs into a standard outlet and heats up the liquid repellent.",
        ["Plugs into standard outlet", "Automatic shut-off after 12 hours"],
        [("Item Volume", "66 Milliliters"), ("Unit Count", "2 count"), ("Item Form", "Oil")],
    )
    details = row.package_details
    assert kind(row) == C.REFILL_TYPE
    assert (details.is_refill_only, details.device_included, details.requires_base_device) == (True, False, True)
    assert (details.pack_quantity, details.net_volume_or_weight) == ("2 x 33 ml", "66 Milliliters")
    assert len(row.listing_integrity_alerts) == 1
    assert row.listing_integrity_alerts[0].startswith("VENDOR_DESCRIPTION_MISMATCH")
    assert "('plugs into outlet', 'automatic shut-off')" in row.listing_integrity_alerts[0]


def test_starter_kit(spark):
    row = analyse(spark, "Raid Liquid Electric Mosquito Killer Primary Unit with Refill", "Comes with a refill.", specs=[("Unit Count", "1 count")])
    assert kind(row) == C.STARTER and row.package_details.device_included and row.listing_integrity_alerts == []


def test_appliance_by_part_of_a_word(spark):
    assert kind(analyse(spark, "Electric Mosquito Killer USBLamp", "trap")) == C.APPLIANCE
    assert kind(analyse(spark, "Wood Clamp")) == C.APPLIANCE


def test_bare_tool_without_specs(spark):
    df = spark.createDataFrame([("Circular Saw, Bare Tool (DCS391B)", "Battery sold separately.", None, None, None)], SCHEMA)
    row = C.classify(df).first()
    assert kind(row) == C.BARE and row.listing_integrity_alerts == [C.BARE_ALERT]
    assert row.package_details.pack_quantity == "1"


def test_accessory(spark):
    row = analyse(spark, "Spigen Ultra Hybrid Protective Case for iPhone 15 Pro Max", "With Super Retina XDR OLED display.")
    assert kind(row) == C.ACCESSORY_TYPE and row.listing_integrity_alerts == [C.ACCESSORY_ALERT]
    assert analyse(spark, "Case for Phone", "Leather").listing_integrity_alerts == []


@pytest.mark.parametrize(
    "title, description, specs, expected",
    [
        ("Towels 4 pack", "", [], C.STANDARD),
        ("Towels 4 pack", "", [("Item form", "Oil")], C.REFILL_TYPE),
        ("Towels 4 pack", "", [("Item Form", "Oil")], C.STANDARD),
        ("Shampoo 100 ml twin pack", "", [], C.REFILL_TYPE),
        ("Plain thing", "fits your existing  printer", [], C.REFILL_TYPE),
        ("Tablet 10 inch", "", [], C.REFILL_TYPE),
        ("Kamera with 18-55mm lens", "", [], C.STARTER),
        ("Machine + grinder", "", [], C.STARTER),
        ("Machine +grinder", "", [], C.APPLIANCE),
        ("Padded thing", "", [], C.STANDARD),
        ("Résumé", "", [], C.STANDARD),
    ],
)
def test_types(spark, title, description, specs, expected):
    assert kind(analyse(spark, title, description, specs=specs)) == expected


def test_refill_notice_and_unknown_device(spark):
    row = analyse(spark, "Scent Refill", "Requires existing unit")
    assert row.listing_integrity_alerts == [C.REFILL_ALERT]
    assert analyse(spark, "Chair").package_details.device_included is None


def test_stems_lose_no_wording(spark):
    """What a kind's patterns match is matched alike behind its stems; texts without a stem never reach a pattern."""
    kinds = [
        (C.STARTER_KIT, C.STARTER_STEMS), (C.BARE_UNIT, C.BARE_STEMS), (C.ACCESSORY, C.ACCESSORY_STEMS), (C.REFILL, C.REFILL_STEMS),
        (C.MULTI_PACK, C.MULTI_PACK_STEMS),
    ]
    samples = {
        r"unit \+ refill": "unit + refill", r"machine \+ ": "machine + x", r"with [0-9\-]+mm lens": "with 18-55mm lens",
        r"(?:case|cover|sleeve|housing|pouch|skin)\s+(?:for|compatible with)": "skin  compatible with",
        r"(?:stand|mount|bracket|dock|holder|tripod|strap|band)\s+(?:for|compatible with)": "dock\tfor",
        "protective (?:case|cover|glass)": "protective glass", r"(?:twin|2|3|4|5|6|12)\s*pack": "12pack",
    }
    texts = [samples.get(w, w.replace("s?", "")) for wordings, _ in kinds for w in wordings] + C.APPLIANCE_PARTS + ["usbphone", "", "padded mat"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for wordings, stems in kinds:
        rows = df.select("t", C.words(F.col("t"), wordings).alias("plain"), C.words(F.col("t"), wordings, stems).alias("quick")).collect()
        assert [x.t for x in rows if x.plain != x.quick] == [] and all(any(x.plain for x in rows if x.t == samples.get(w, w.replace("s?", ""))) for w in wordings)
    parts = df.select(F.col("t").rlike("|".join(C.APPLIANCE_PARTS)).alias("plain"), C.holds_any(F.col("t"), C.APPLIANCE_PARTS).alias("quick")).collect()
    assert all(x.plain == x.quick for x in parts)
    assert spark.range(3).select(C.holds_any(F.lit("own skin"), C.ACCESSORY_STEMS).alias("x")).first().x is False
