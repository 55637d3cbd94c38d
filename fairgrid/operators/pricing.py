"""Buylists, prices and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairgrid.functions import text
from fairgrid.operators.search import if_small

#: Estimated total of an order: a share on top of the subtotal and a flat fee.
MARKUP, FEE = 1.2, 20.0


def parse_buylists(lists: DataFrame, text_col: str = "text") -> DataFrame:
    """A row for each line of a buylist: the other columns, ``line``, ``quantity``, ``card``."""
    rest = [c for c in lists.columns if c != text_col]
    return lists.select(*rest, F.posexplode(text.buylist_lines(F.col(text_col))).alias("line", "_item")).select(*rest, "line", "_item.quantity", "_item.card")


def price_lines(lines: DataFrame, prices: DataFrame) -> DataFrame:
    """Lines with unit and total prices by normalised card name; CNY falls back to USD.

    ``prices`` may hold a card several times: the row with the greatest ``updated_at`` counts (without that column the
    greatest prices). A card that is unknown or has neither price has ``found`` false. ``card_number`` and ``set`` of
    the price row are carried where ``prices`` has them, for cards that are found.
    """
    more = [c for c in ("card_number", "set") if c in prices.columns]
    newest = F.struct(*([F.col("updated_at")] if "updated_at" in prices.columns else []), "price_usd", "price_cny", *more)
    book = prices.groupBy(text.normalised(F.col("card")).alias("_key")).agg(F.max(newest).alias("_p")).select("_key", "_p.price_usd", "_p.price_cny", *(f"_p.{c}" for c in more))
    book = book.withColumn("_found", F.coalesce("price_usd", "price_cny").isNotNull())
    met = lines.withColumn("_key", text.normalised(F.col("card"))).join(if_small(book), "_key", "left").drop("_key")
    unit = F.coalesce("price_cny", "price_usd")
    met = met.withColumns({c: F.when(F.col("_found"), F.col(c)) for c in more})
    return met.withColumn("unit_cny", unit).withColumn("total_cny", unit * F.col("quantity")).withColumn("found", F.coalesce("_found", F.lit(False))).drop("_found", "price_cny")


def buylist_totals(priced: DataFrame, key: str) -> DataFrame:
    """Cards, lines, subtotal, whether all were found and whether the list is valid."""
    return priced.groupBy(key).agg(
        F.sum("quantity").alias("total_cards"), F.count(F.lit(1)).alias("line_items"), F.sum(F.coalesce("total_cny", F.lit(0.0))).alias("subtotal_cny"), F.bool_and("found").alias("all_found")
    ).withColumn("valid", (F.col("line_items") > 0) & (F.coalesce("total_cards", F.lit(0)) > 0))


def set_prices(prices: DataFrame, changes: DataFrame) -> DataFrame:
    """``prices`` with ``changes`` (card, price_usd, updated_at) over them by normalised card name; a change's last row wins."""
    key = text.normalised(F.col("card"))
    last = changes.groupBy(key.alias("_key")).agg(F.max_by(F.struct(F.trim("card").alias("card"), "price_usd", "updated_at"), "updated_at").alias("_c"))
    kept = prices.withColumn("_key", key).join(last.select("_key"), "_key", "left_anti").select(prices.columns)
    return kept.unionByName(last.select("_c.card", "_c.price_usd", F.lit(None).cast(prices.schema["price_cny"].dataType).alias("price_cny"), "_c.updated_at"))


def estimated_total(totals: DataFrame) -> DataFrame:
    """Add ``estimate``."""
    return totals.withColumn("estimate", F.col("subtotal_cny") * MARKUP + FEE)


def orders(priced: DataFrame, key: str) -> DataFrame:
    """Order documents: an array of priced lines with each order's subtotal and status."""
    item = F.struct("line", "quantity", "card", *(c for c in ("card_number", "set") if c in priced.columns), "unit_cny", "total_cny", "found")
    return priced.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum(F.coalesce("total_cny", F.lit(0.0))).alias("subtotal_cny")).withColumn("status", F.lit("pending"))


def order_totals(priced: DataFrame, key: str) -> DataFrame:
    """``subtotal_cny``, ``items`` (how many lines) and the estimate of each order, by a plain aggregate that task sides combine."""
    return estimated_total(priced.groupBy(key).agg(F.sum(F.coalesce("total_cny", F.lit(0.0))).alias("subtotal_cny"), F.count(F.lit(1)).alias("items")))


# The columns of the table in an order's message.
TABLE_HEAD = "Qty  Set/Number    Card Name                  Unit CNY   Total CNY"
TABLE_RULE = "---  ------------  -------------------------  --------  ----------"


def order_message(order_docs: DataFrame, key: str) -> DataFrame:
    """``message``: what tells of an order: its id, the quick list, a table of the items, subtotal and estimate, and whether cards weren't found.

    Names are cut to 25 letters, missing numbers and prices are dashes. ``order_docs`` is what :func:`orders` gives of
    lines with ``card_number`` and ``set``.
    """
    money = lambda c, width: F.lpad(F.when(c.isNotNull(), F.format_string("¥%.2f", c)).otherwise(F.lit("—")), width, " ")
    quick = lambda i: text.quick_line(i["quantity"], i["set"], i["card_number"], i["card"])

    def row(i: Column) -> Column:
        code = F.coalesce(F.concat(text.blank_to_null(i["set"]), F.lit(" "), text.blank_to_null(i["card_number"])), F.lit("—"))
        wide = F.when(F.length(code) < 12, F.rpad(code, 12, " ")).otherwise(code)
        amount = i["quantity"].cast("string")
        return F.concat_ws("  ", F.when(F.length(amount) < 3, F.lpad(amount, 3, " ")).otherwise(amount), wide, F.rpad(F.substring(i["card"], 1, 25), 25, " "), money(i["unit_cny"], 8), money(i["total_cny"], 10))

    told = estimated_total(order_docs)
    cards = F.aggregate("items", F.lit(0).cast("long"), lambda n, i: n + F.coalesce(i["quantity"].cast("long"), F.lit(0)))
    sums = [F.concat(F.lit(" " * 45 + name), F.format_string("¥%.2f", c)) for name, c in (("Subtotal: ", "subtotal_cny"), ("Est Total: ", "estimate"))]
    lacking = F.when(F.exists("items", lambda i: ~i["found"]), F.lit("Some cards have no price."))
    parts = [F.concat(F.lit("Order "), F.col(key).cast("string")), F.concat(F.lit("Quick list ("), cards.cast("string"), F.lit(" cards):")), F.array_join(F.transform("items", quick), "\n"), F.lit(TABLE_HEAD), F.lit(TABLE_RULE), F.array_join(F.transform("items", row), "\n"), F.lit(TABLE_RULE), *sums, lacking]
    return told.select(key, F.concat_ws("\n", *parts).alias("message"))


def rejects(lines: DataFrame, most: int = 3) -> DataFrame:
    """Lines that an order can't take, with the reason."""
    reason = F.when(F.col("quantity").isNull(), "unreadable quantity").when(F.col("quantity") > most, "too many").when(F.col("quantity") < 1, "no quantity").when(F.trim("card") == "", "no name")
    return lines.withColumn("reason", reason).where("reason is not null")


def recent(rows: DataFrame, by: str, tie: str, limit: int = 50) -> DataFrame:
    """The newest rows."""
    return rows.orderBy(F.desc(by), tie).limit(limit)
