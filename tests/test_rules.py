"""Rules over whole listings go through them once."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import rules

LISTED = "id string, product_id string, last_price double, last_cart_price double, last_sizes array<struct<name:string,size:string,in_stock:boolean>>, last_in_stock boolean, active boolean"


@pytest.mark.parametrize("of", ["product", "family"])
def test_listings_are_gone_through_once(spark, of):
    asked = [("plain", "p1", 100.0, None, False, 24.0, True), ("sized", "p1", 100.0, "42", False, 24.0, True), ("alone", "p3", 100.0, None, True, 24.0, True)]
    if of == "family":
        asked += [("wide", "p1", 90.0, None, True, 24.0, True), ("wide sized", "p2", 200.0, "42", True, 24.0, True), ("nothing", "p4", 100.0, None, True, 24.0, True)]
    rules_of = spark.createDataFrame(asked, "id string, product_id string, target_price double, size string, spectrum_mode boolean, cooldown_hours double, enabled boolean")
    products = spark.createDataFrame([("p1", "P1", "f", True), ("p2", "P2", "f", True), ("p3", "P3", None, True), ("p4", "P4", "g", True)], "id string, name string, family_key string, active boolean")
    offers = [("a", "p1", 110.0, None, [("42", "42", True)], True, True), ("b", "p2", 95.0, None, [("41", "41", True)], True, True), ("c", "p2", 150.0, None, [("42", "42", True)], True, True)]
    offers += [("d", "p3", 99.0, 1.0, None, True, True), ("e", "p3", 98.0, None, [("42", "42", False)], True, True), ("f", "p1", 50.0, None, None, True, False), ("g", "p1", None, None, None, True, True)]
    looked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def price(value):
        looked.add(1)
        return value

    listings = spark.createDataFrame(offers, LISTED).withColumn("last_price", price.asNondeterministic()("last_price"))
    got = {(r.rule_id, r.listing_id, r.price, r["size"]) for r in rules.evaluate_rules(rules_of, products, listings).collect()}
    want = {("plain", "a", 110.0, "Herhangi bir beden"), ("sized", "a", 110.0, "42"), ("alone", "d", 99.0, "Beden bilgisi yok")}
    if of == "family":
        want |= {("wide", "b", 95.0, "Herhangi bir beden"), ("wide sized", "a", 110.0, "42")}
    assert got == want
    assert looked.value <= len(offers)
