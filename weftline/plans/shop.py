"""A shop of six tables: what the generation benchmark and tests make."""

from __future__ import annotations

from weftline.plans.build import build_plan
from weftline.plans.model import Check, Column, ForeignKey, Plan, Schema, Table


def shop_schema() -> Schema:
    c = Column
    return Schema.of(
        Table("users", (c("id", "uuid", primary=True), c("email", unique=True), c("first_name"), c("last_name"), c("role", "enum", enum_values=("customer", "admin")), c("referred_by", "uuid", nullable=True), c("created_at", "timestamp"), c("is_active", "boolean")), ("id",), (ForeignKey(("referred_by",), "users", ("id",)),)),
        Table("products", (c("id", "uuid", primary=True), c("name"), c("price", "float", precision=12, scale=2), c("sku", unique=True), c("description", native="text", nullable=True)), ("id",)),
        Table("tags", (c("id", "uuid", primary=True), c("name")), ("id",)),
        Table("product_tags", (c("product_id", "uuid"), c("tag_id", "uuid")), ("product_id", "tag_id"), (ForeignKey(("product_id",), "products", ("id",)), ForeignKey(("tag_id",), "tags", ("id",)))),
        Table("orders", (c("id", "uuid", primary=True), c("user_id", "uuid"), c("status", "enum", enum_values=("pending", "shipped", "delivered", "cancelled")), c("total", "float"), c("created_at", "timestamp")), ("id",), (ForeignKey(("user_id",), "users", ("id",)),)),
        Table("order_items", (c("id", "uuid", primary=True), c("order_id", "uuid"), c("product_id", "uuid"), c("quantity", "integer"), c("unit_price", "float", precision=12, scale=2)), ("id",), (ForeignKey(("order_id",), "orders", ("id",)), ForeignKey(("product_id",), "products", ("id",))), (), (Check("positive", "quantity > 0"),)),
    )


def shop_plan(users: int, products: int, tags: int, seed: int = 42) -> Plan:
    per = lambda low, high: {"kind": "uniformInt", "min": low, "max": high}
    tables = {"users": {"count": users}, "products": {"count": products}, "tags": {"count": tags}, "orders": {"countPerParent": per(1, 3)}, "order_items": {"countPerParent": per(1, 5)}, "product_tags": {"countPerParent": per(1, 5)}}
    return build_plan(shop_schema(), {"tables": tables, "seed": seed})
