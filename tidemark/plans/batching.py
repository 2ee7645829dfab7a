"""Random mini-batches that any engine can compute: a row's batch depends on its values alone."""

from __future__ import annotations

#: Columns whose values tell a table's rows apart, with their factors.
IDENTITY = {
    "lineitem": (("l_orderkey", 1000003), ("l_partkey", 97), ("l_suppkey", 13), ("l_linenumber", 1)),
    "orders": (("o_orderkey", 1000003), ("o_custkey", 97)),
    "customer": (("c_custkey", 1000003), ("c_nationkey", 97)),
    "events": (("event_id", 1000003), ("user_id", 97)),
}


def seed_sql(table: str) -> str:
    """A number below 2 ** 32 whose high bits are well mixed."""
    total = " + ".join(f"CAST({c} AS BIGINT) * {k}" for c, k in IDENTITY[table])
    return f"((({total}) % 2147483648) * 2654435761) % 4294967296"


def batch_sql(table: str, batches: int, divide: str = "div") -> str:
    return f"(({seed_sql(table)}) {divide} 65536) % {batches}"
