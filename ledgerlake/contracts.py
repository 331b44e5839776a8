"""Table contracts: columns, types, keys and limits of the store and publish tables.

Parquet enforces none of these, so `operators.quality.enforce_contract` checks them
before a load. Identifiers are 32-bit integers as in the source system; pass
``id_type="bigint"`` where they can outgrow that.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    raw: str | None = None  # column of the raw table, if taken from one
    blank_is_null: bool = False
    trim: bool = False
    not_null: bool = False
    max_length: int | None = None


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableContract:
    name: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    foreign_keys: tuple[ForeignKey, ...] = field(default=())

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.fields]


def sales_contracts(id_type: str = "int") -> dict[str, TableContract]:
    """Contracts of the three store and two publish tables.

    The names, types and lengths below are fixed values."""
    product = (
        Field("product_id", id_type, "ProductID", not_null=True),
        Field("product_desc", "string", "ProductDesc", max_length=255),
        Field("product_number", "string", "ProductNumber", max_length=50),
        Field("make_flag", "boolean", "MakeFlag"),
        Field("color", "string", "Color", blank_is_null=True, max_length=50),
        Field("safety_stock_level", "int", "SafetyStockLevel"),
        Field("reorder_point", "int", "ReorderPoint"),
        Field("standard_cost", "decimal(18,6)", "StandardCost"),
        Field("list_price", "decimal(18,6)", "ListPrice"),
        Field("size", "string", "Size", blank_is_null=True, max_length=20),
        Field(
            "size_unit_measure_code",
            "string",
            "SizeUnitMeasureCode",
            blank_is_null=True,
            max_length=10,
        ),
        Field("weight", "float", "Weight", blank_is_null=True),
        Field(
            "weight_unit_measure_code",
            "string",
            "WeightUnitMeasureCode",
            blank_is_null=True,
            max_length=10,
        ),
        Field(
            "product_category_name",
            "string",
            "ProductCategoryName",
            blank_is_null=True,
            max_length=100,
        ),
        Field(
            "product_sub_category_name",
            "string",
            "ProductSubCategoryName",
            blank_is_null=True,
            max_length=100,
        ),
    )
    header = (
        Field("sales_order_id", id_type, "SalesOrderID", not_null=True),
        Field("order_date", "date", "OrderDate", not_null=True),
        Field("ship_date", "date", "ShipDate", not_null=True),
        Field("online_order_flag", "boolean", "OnlineOrderFlag"),
        Field("account_number", "string", "AccountNumber", trim=True, max_length=20),
        Field("customer_id", id_type, "CustomerID", not_null=True),
        Field("sales_person_id", id_type, "SalesPersonID", blank_is_null=True),
        Field("freight", "decimal(18,4)", "Freight"),
    )
    detail = (
        Field("sales_order_detail_id", id_type, "SalesOrderDetailID", not_null=True),
        Field("sales_order_id", id_type, "SalesOrderID", not_null=True),
        Field("order_qty", "int", "OrderQty"),
        Field("product_id", id_type, "ProductID"),
        Field("unit_price", "decimal(18,6)", "UnitPrice"),
        Field("unit_price_discount", "decimal(18,6)", "UnitPriceDiscount"),
    )
    stamp = Field("etl_created_at", "timestamp")
    source = Field("source_file_name", "string")
    published_product = tuple(
        Field("color", "string", not_null=True, max_length=50) if f.name == "color" else f
        for f in product
    )
    by_name = {f.name: f for f in (*header, *detail)}
    orders = (
        by_name["sales_order_detail_id"],
        by_name["sales_order_id"],
        by_name["order_qty"],
        by_name["product_id"],
        by_name["unit_price"],
        by_name["unit_price_discount"],
        Field("total_line_extended_price", "decimal(18,6)"),
        Field("order_date", "date"),
        Field("ship_date", "date"),
        by_name["online_order_flag"],
        by_name["account_number"],
        Field("customer_id", id_type),
        by_name["sales_person_id"],
        Field("total_order_freight", "decimal(18,4)"),
        Field("lead_time_in_business_days", "int"),
        stamp,
    )
    tables = (
        TableContract("store_product_master", ("product_id",), (*product, stamp, source)),
        TableContract("store_sales_order_header", ("sales_order_id",), (*header, stamp, source)),
        TableContract(
            "store_sales_order_detail",
            ("sales_order_detail_id",),
            (*detail, stamp, source),
            (
                ForeignKey("sales_order_id", "store_sales_order_header", "sales_order_id"),
                ForeignKey("product_id", "store_product_master", "product_id"),
            ),
        ),
        TableContract("publish_product", ("product_id",), (*published_product, stamp)),
        TableContract("publish_orders", ("sales_order_detail_id",), orders),
    )
    return {t.name: t for t in tables}
