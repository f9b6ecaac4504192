"""Where queries and their SQL are gathered, and texts that several of them share."""

from __future__ import annotations

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def ym(x: str) -> str:
    return f"concat(cast(year({x}) as string),'-',lpad(cast(month({x}) as string),2,'0'))"


def yh(x: str) -> str:
    return f"concat(cast(year({x}) as string),'-H',case when month({x})<=6 then '1' else '2' end)"


def years(x: str, first: int, last: int) -> str:
    return f"{x} >= timestamp '{first}-01-01 00:00:00' and {x} < timestamp '{last + 1}-01-01 00:00:00'"


HOURS = "hour(ts) between 6 and 23"
ORDERS = "orders join customer on o_custkey = c_custkey"
EVENTS = "events join customer on user_id = c_custkey"
ORDERS_IN = years("o_orderdate", 1997, 1998)
EVENTS_IN = years("ts", 2024, 2025)
ITEMS_IN = years("l_shipdate", 1997, 1998)
