"""Small frames for the tests."""

from __future__ import annotations

from datetime import date, timedelta


def day(text: str) -> date:
    return date.fromisoformat(text if len(text) > 5 else f"2020-{text}")


def item(n) -> str:
    return str(n).zfill(10)


def tx(spark, rows):
    """rows (user, item number, day, price, channel)."""
    return spark.createDataFrame([(u, item(i), day(d), p, c) for u, i, d, p, c in rows], "user_id string, item_id string, date date, price double, channel int")


def inter(spark, rows):
    """rows (user, item number, day)."""
    return spark.createDataFrame([(u, item(i), day(d)) for u, i, d in rows], "user_id string, item_id string, date date")


def articles(spark, rows):
    """rows (item number, style, colour, department, type)."""
    schema = "item_id string, product_code string, colour_group_name string, department_name string, product_type_name string, section_name string, garment_group_name string, prod_name string, detail_desc string"
    return spark.createDataFrame([(item(i), s, c, d, t, "S", "G", f"{c} {t}", f"{c} cotton {t}") for i, s, c, d, t in rows], schema)


def days_before(d: date, n: int) -> date:
    return d - timedelta(days=n)
