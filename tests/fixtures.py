"""Small fixture tables (FIXTURES.md): the Sales sample of the reference and edge cases."""

# The reference's Sales sample table.
SALES = {
    "Month": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
    "Sales": [12000, 15000, 13500, 18000, 21000, 19500, 22000, 24000, 20000, 17000, 25000, 28000],
    "Profit": [2400, 3200, 2700, 4000, 5000, 4500, 5200, 6100, 4800, 3900, 6500, 7800],
    "Customers": [120, 145, 138, 167, 189, 175, 195, 212, 181, 160, 230, 260],
    "Region": ["North", "South"] * 6,
    "Category": ["A", "B", "A", "C", "B", "A", "C", "B", "A", "C", "B", "A"],
}


def sales(spark):
    rows = list(zip(*SALES.values()))
    return spark.createDataFrame(rows, "Month string, Sales long, Profit long, Customers long, "
                                       "Region string, Category string")
