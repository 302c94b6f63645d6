"""Tables by JDBC, in a database in memory, against the same rows from Parquet."""

import uuid

import pytest
from pyspark.sql import functions as F

from shelfspark.sources.database import Database
from shelfspark.sources.tables import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="module")
def db(spark, tables):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    known = Database(spark, f"jdbc:derby:memory:m{uuid.uuid4().hex};create=true", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    text = "name VARCHAR(200), brand VARCHAR(50), kind VARCHAR(50)"
    known.create(tables.products(), "products", "product_id", text)
    prices = tables.history().select(F.col("seq.l_orderkey").alias("o"), F.col("seq.l_linenumber").alias("l"), "product_id", "price").select((F.col("o") * 100 + F.col("l")).alias("id"), "product_id", "price")
    known.create(prices, "prices", "id")
    return known


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_scan_equals_parquet_and_is_pushed(db, tables):
    assert rows(db.scan("products", "product_id")) == rows(tables.products())
    found = db.scan("products", "product_id", 4).where("active and shoe_size > 20").select("product_id", "name")
    assert found.rdd.getNumPartitions() == 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(shoe_size,20)" in plan and "brand" not in plan.split("ReadSchema")[1]
    assert rows(found) == rows(tables.products().where("active and shoe_size > 20").select("product_id", "name"))


def test_first_rows(db, tables):
    latest = db.first("products", 5, {"product_id": "desc"})
    assert [r.product_id for r in latest.collect()] == [r.product_id for r in tables.products().orderBy(F.desc("product_id")).limit(5).collect()]
    assert rows(db.first("products", 20, {"name": "asc", "product_id": "desc"}, '"active"')) == rows(tables.products().where("active").orderBy("name", F.desc("product_id")).limit(20))
    with pytest.raises(ValueError, match="asc or desc"):
        db.first("products", 5, {"name": "up"})


def test_append_again_adds_nothing_and_delete_takes_children(db, tables, spark):
    before = db.scan("products").count()
    new = tables.products().limit(3).withColumn("product_id", F.col("product_id") + 1_000_000)
    odd = new.limit(1).withColumn("product_id", F.lit(None).cast("long"))
    for _ in range(2):
        db.append(new.unionByName(new).unionByName(odd).unionByName(tables.products()), "products", "product_id")
        assert db.scan("products", "product_id").count() == before + 3
    gone = tables.products().select("product_id").where("product_id % 2 = 0").unionByName(odd.select("product_id"))
    db.delete(gone, "products", "product_id", {"prices": "product_id"})
    assert db.scan("products").where("product_id < 1000000 and product_id % 2 = 0").count() == 0
    assert rows(db.scan("prices", "id").select("product_id").distinct()) == rows(tables.history().where("product_id % 2 = 1").select("product_id").distinct())
    db.delete(gone.limit(0), "products", "product_id")
    db.delete(db.scan("products").select("product_id"), "products", "product_id", {"prices": "product_id"})
    assert db.scan("products", "product_id").count() == db.scan("prices", "id").count() == 0


def test_a_failed_delete_leaves_everything(db, tables):
    db.append(tables.products(), "products", "product_id")
    with pytest.raises(Exception, match="(?i)no_such|does not exist"):
        db.delete(tables.products().select("product_id"), "products", "product_id", {"prices": "product_id", "no_such": "id"})
    assert db.scan("products", "product_id").count() == tables.products().count()
