"""Tables of the retail data set: columns in file order, and what queries need of them."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

#: Name and kind of each column.  Kinds: str, whole, real, flag, day, time.
TABLES: dict[str, list[tuple[str, str]]] = {
    "transactions": [
        ("transaction_id", "str"), ("store_id", "whole"), ("payment_method_id", "whole"), ("voucher_id", "whole"), ("user_id", "whole"),
        ("original_amount", "real"), ("discount_applied", "real"), ("final_amount", "real"), ("created_at", "time"),
    ],
    "transaction_items": [("transaction_id", "str"), ("item_id", "whole"), ("quantity", "whole"), ("unit_price", "real"), ("subtotal", "real"), ("created_at", "time")],
    "menu_items": [
        ("item_id", "whole"), ("item_name", "str"), ("category", "str"), ("price", "real"), ("is_seasonal", "flag"), ("available_from", "time"), ("available_to", "time"),
    ],
    "stores": [
        ("store_id", "whole"), ("store_name", "str"), ("street", "str"), ("postal_code", "str"), ("city", "str"), ("state", "str"), ("latitude", "real"), ("longitude", "real"),
    ],
    "users": [("user_id", "whole"), ("gender", "str"), ("birthdate", "day"), ("registration_at", "time")],
}

#: Columns that the queries need.
NEEDED: dict[str, list[str]] = {
    "transactions": ["transaction_id", "store_id", "user_id", "final_amount", "created_at"],
    "transaction_items": ["transaction_id", "item_id", "quantity", "subtotal", "created_at"],
    "menu_items": ["item_id", "item_name"],
    "stores": ["store_id", "store_name"],
    "users": ["user_id", "birthdate"],
}


def text_schema(table: str) -> StructType:
    """All columns as text, in file order."""
    return StructType([StructField(name, StringType()) for name, _ in TABLES[table]])


def table_of(path: str) -> str:
    """The table that a file belongs to, by its name: the longer of two names that both occur decides."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    found = [t for t in TABLES if t in name]
    if not found:
        raise ValueError(f"no table for {path!r}")
    return max(found, key=len)
