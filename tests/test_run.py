"""All layers over three small CSV feeds with the faults real ones have."""

import datetime as dt
import os
from decimal import Decimal

import pytest

from ledgerlake.plans import analysis, run, validation

PRODUCTS = """ProductID,ProductDesc,ProductNumber,MakeFlag,Color,SafetyStockLevel,ReorderPoint,StandardCost,ListPrice,Size,SizeUnitMeasureCode,Weight,WeightUnitMeasureCode,ProductCategoryName,ProductSubCategoryName
680,"HL Road Frame - Black, 58",FR-R92B-58,True,Black,500,375,1059.31,1431.5,58,CM ,2.24,LB ,"",Road Frames
707,"Helmet ""Sport""
red",HL-U509-R,False,Red,4,3,13.0863,34.99,,"",,,"",Helmets
713,"Long-Sleeve Logo Jersey, S",LJ-0192-S,False,Multi,4,3,38.4923,49.99,S,,,,"",Jerseys
713,"Long-Sleeve Logo Jersey, S",LJ-0192-S,False,Multi,4,3,38.4923,49.99,S,,,,Clothing,Shirt
900,Mystery,MY-1,False,"",4,3,1,2,,,,,"",Unknown
"""
HEADERS = """SalesOrderID,OrderDate,ShipDate,OnlineOrderFlag,AccountNumber,CustomerID,SalesPersonID,Freight
1,2021-05-31,2021-06-07,False, 10-4030-000001 ,11,279,616.094
2,2021-06,2021-07-05,True,10-4030-000002,12,"",89.4568
3,2022-01-03,2022-01-05,True,10-4030-000003,13,,1.5
"""
DETAILS = """SalesOrderID,SalesOrderDetailID,OrderQty,ProductID,UnitPrice,UnitPriceDiscount
1,101,1,680,2024.9940,.0000
1,102,-1,707,5.70,.0000
2,103,2,713,10.00,0.50
3,104,4,707,20.19,.0000
3,105,1,,7.00,.0000
3,106,-1,900,1.00,.0000
"""
FIRST, SECOND, THIRD = "2026-01-15 06:00:00", "2026-01-16 06:00:00", "2026-01-17 06:00:00"


def put(folders, entity, text):
    os.makedirs(folders[entity], exist_ok=True)
    with open(f"{folders[entity]}/{entity}.csv", "w", encoding="utf-8", newline="") as f:
        f.write(text)


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("feeds"))
    folders = {e: f"{base}/{e}" for e in run.ENTITIES}
    for entity, text in zip(run.ENTITIES, (PRODUCTS, HEADERS, DETAILS), strict=True):
        put(folders, entity, text)
    lake = run.Lake(spark, str(tmp_path_factory.mktemp("lake")), buckets=3)
    report = run.run_all(lake, folders, FIRST)
    return lake, folders, report


def by_key(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_store(state):
    lake, _, _ = state
    products = by_key(lake.keyed("store_product_master").read(), "product_id")
    assert sorted(products) == [680, 707, 713, 900]
    assert products[713]["product_category_name"] == "Clothing"
    assert products[707]["product_desc"] == 'Helmet "Sport"\nred'
    assert products[680]["standard_cost"] == Decimal("1059.310000")
    assert products[680]["size_unit_measure_code"] == "CM"
    assert products[680]["source_file_name"] == "products.csv"
    assert products[900]["color"] is None
    headers = by_key(lake.keyed("store_sales_order_header").read(), "sales_order_id")
    assert headers[2]["order_date"] == dt.date(2021, 6, 28)
    assert headers[2]["sales_person_id"] is None
    assert headers[1]["account_number"] == "10-4030-000001"
    assert headers[1]["freight"] == Decimal("616.0940")


def test_publish(state):
    lake, _, _ = state
    products = by_key(lake.keyed("publish_product").read(), "product_id")
    assert products[900]["color"] == "N/A"
    assert [products[p]["product_category_name"] for p in (680, 707, 713, 900)] == [
        "Components", "Accessories", "Clothing", None,
    ]
    orders = lake.keyed("publish_orders").read()
    assert orders.columns == lake.contracts["publish_orders"].columns
    assert {f.name: f.dtype for f in lake.contracts["publish_orders"].fields} == dict(orders.dtypes)
    lines = by_key(orders, "sales_order_detail_id")
    assert lines[102]["total_line_extended_price"] == Decimal("-5.700000")
    assert lines[103]["total_line_extended_price"] == Decimal("19.000000")
    assert lines[101]["lead_time_in_business_days"] == 5
    assert lines[104]["lead_time_in_business_days"] == 2


def test_analysis(state):
    lake, _, _ = state
    q1 = lake.rebuilt("analysis_revenue_by_color_year").read().collect()
    assert [tuple(r) for r in q1] == [
        (2021, "Black", Decimal("2024.99")), (2022, "Red", Decimal("80.76")),
    ]
    q2 = by_key(lake.rebuilt("analysis_avg_lead_time_by_category").read(), "product_category_name")
    assert q2["Accessories"]["avg_lead_time_business_days"] == Decimal("3.50")
    assert None not in q2
    counted = analysis.lead_time_by_category(
        lake.keyed("publish_orders").read(), lake.keyed("publish_product").read()
    )
    assert by_key(counted, "product_category_name")["Accessories"]["order_lines"] == 2


def test_report(state):
    _, _, report = state
    checks = report.collect()
    assert len(checks) == 29
    failed = {(r["check_name"], r["severity"], r["measure"]) for r in checks if r["status"] == "fail"}
    assert failed == {("product_id in store_product_master", "warning", 1)}


def test_second_and_third_run(state):
    lake, folders, _ = state
    for entity in run.ENTITIES:
        assert run.ingest(lake, entity, folders[entity], SECOND) == 0
    put(folders, "sales_order_detail", DETAILS.replace("3,104,4,", "3,104,5,").replace("2,103", "2,203"))
    assert run.ingest(lake, "sales_order_detail", folders["sales_order_detail"], THIRD) == 1
    manifest = by_key(lake.manifest_rows(), "file_key")
    assert manifest["sales_order_detail/sales_order_detail.csv"]["load_count"] == 2
    assert manifest["products/products.csv"]["load_count"] == 1
    assert lake.raw("raw_sales_order_detail").read().count() == 12
    assert lake.raw("raw_sales_order_detail").latest().count() == 6
    run.load_store_detail(lake, THIRD)
    run.load_publish_orders(lake, THIRD)
    lines = by_key(lake.keyed("publish_orders").read(), "sales_order_detail_id")
    assert sorted(lines) == [101, 102, 103, 104, 105, 106, 203]
    assert lines[104]["order_qty"] == 5


def test_bad_batch_is_refused_as_a_whole(state):
    lake, folders, _ = state
    table = lake.keyed("store_sales_order_detail")
    version = table.version
    put(folders, "sales_order_detail", DETAILS + "99,300,1,680,1.00,0\n3,301,1,12345,1.00,0\n")
    run.ingest(lake, "sales_order_detail", folders["sales_order_detail"], "2026-01-18 06:00:00")
    with pytest.raises(ValueError, match="(?s)sales_order_id = 1.*|product_id = 1"):
        run.load_store_detail(lake, "2026-01-18 06:00:00")
    assert table.version == version


def test_missing_source(state, tmp_path):
    lake, _, _ = state
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError, match="products"):
        run.ingest(lake, "products", str(empty), FIRST)


def test_critical_findings_raise_together(state):
    lake, _, _ = state
    tables = run.all_tables(lake)
    tables["publish_product"] = tables["publish_product"].withColumn(
        "color", tables["publish_product"]["size"]
    )
    tables["raw_product_master"] = tables["raw_product_master"].limit(0)
    with pytest.raises(ValueError, match="(?s)color filled in = .*not empty = 0"):
        validation.assert_no_critical(validation.validation_report(tables))


HEAD = PRODUCTS.splitlines()[0] + "\n"


def product(key, color="Red"):
    return f"{key},Thing,T-{key},True,{color},4,3,1,2,,,,,Clothing,Socks\n"


@pytest.fixture
def lake(spark, tmp_path):
    return run.Lake(spark, str(tmp_path / "lake"), buckets=2)


def deliver(lake, folder, name, text, batch_ts):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(text)
    return run.ingest(lake, "products", str(folder), batch_ts)


def colors(lake, name):
    return {r["product_id"]: r["color"] for r in lake.keyed(name).read().collect()}


def test_raw_batches_wait_until_the_store_has_them(lake, tmp_path):
    folder = tmp_path / "in"
    deliver(lake, folder, "a.csv", HEAD + product(1) + product(2), FIRST)
    deliver(lake, folder, "b.csv", HEAD + product(2, "Blue") + product(3), SECOND)
    report = run.load_store_product(lake, SECOND)
    assert report["rows"] == 3 and report["rows_dropped"] == 1
    assert colors(lake, "store_product_master") == {1: "Red", 2: "Blue", 3: "Red"}
    version = lake.keyed("store_product_master").version
    assert run.load_store_product(lake, THIRD) == run.NOTHING
    assert lake.keyed("store_product_master").version == version


def test_store_versions_wait_until_they_are_published(lake, tmp_path):
    folder = tmp_path / "in"
    for n, ts in enumerate((FIRST, SECOND), 1):
        deliver(lake, folder, f"{n}.csv", HEAD + product(n) + product(9, f"c{n}"), ts)
        run.load_store_product(lake, ts)
    run.load_publish_product(lake, SECOND)
    assert colors(lake, "publish_product") == {1: "Red", 2: "Red", 9: "c2"}
    deliver(lake, folder, "3.csv", HEAD + product(3), THIRD)
    run.load_store_product(lake, THIRD)
    assert run.load_publish_product(lake, THIRD)["rows"] == 1
    assert sorted(colors(lake, "publish_product")) == [1, 2, 3, 9]
    assert run.load_publish_product(lake, THIRD) == run.NOTHING


def test_a_refused_batch_is_not_hidden_by_the_next(lake, tmp_path):
    folder = tmp_path / "in"
    deliver(lake, folder, "a.csv", HEAD + product(1) + product("x"), FIRST)
    for name, ts in (("b.csv", SECOND), ("c.csv", THIRD)):
        deliver(lake, folder, name, HEAD + product(len(name) + ord(name[0])), ts)
        with pytest.raises(ValueError, match="not null product_id = 1"):
            run.load_store_product(lake, ts)
    lake.raw("raw_product_master").withdraw(run.batch_id_of(FIRST))
    assert run.load_store_product(lake, THIRD)["rows"] == 2


def test_named_and_empty_files(lake, tmp_path):
    folder = tmp_path / "in"
    assert deliver(lake, folder, "empty.csv", "", FIRST) == 1
    assert lake.raw("raw_product_master").entries() == []
    assert deliver(lake, folder, "a.csv", HEAD + product(1), SECOND) == 1
    hashes = {r["file_key"]: r["file_size_bytes"] for r in lake.manifest_rows().collect()}
    assert hashes["products/empty.csv"] == 0 and hashes["products/a.csv"] > 0
    with pytest.raises(FileNotFoundError, match="z.csv"):
        run.ingest(lake, "products", str(folder), THIRD, ["a.csv", "empty.csv", "z.csv"])


def test_the_gate_looks_at_what_was_written(lake, tmp_path):
    folder = tmp_path / "in"
    deliver(lake, folder, "a.csv", HEAD + "".join(map(product, range(20))), FIRST)
    run.load_store_product(lake, FIRST)
    run.gate(lake, "store_product_master")
    deliver(lake, folder, "b.csv", HEAD + product(5, "Blue"), SECOND)
    run.load_store_product(lake, SECOND)
    written = lake.keyed("store_product_master").rewritten()
    assert 0 < written.count() < 20 and written.where("product_id = 5").count() == 1
    run.gate(lake, "store_product_master")
