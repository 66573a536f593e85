"""Views that give the driver's tables the shape of forecasts, observations and tracks, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_cell_day": """select l_suppkey % 10 as cell_id, 8e1 - 16e0*(l_suppkey % 10) as lat, cast(l_shipdate as date) as day, l_returnflag as model, l_linestatus as source, 6*l_linenumber as lead_h,
        l_extendedprice as pred, l_extendedprice*(1-l_discount) as truth, l_quantity*1e3 as clim from {lineitem}""",
    "fx_daily": "select cell_id, lat, day, max(pred) as tmax_pred, max(truth) as tmax_truth, min(pred) as tmin_pred, min(truth) as tmin_truth from {fx_cell_day} group by cell_id, lat, day",
    "fx_station_obs": "select user_id as station, ts, event_type as variable, value, -6e1 + 12e1*((user_id*37) % 101)/101e0 as lat, 36e1*((user_id*53) % 97)/97e0 as lon from {events}",
    "fx_track": """select user_id as sid, event_type as model, ts as valid_time, 1e1 + value/2e1 as pred_lat, 12e1 + (event_id % 50)/5e0 as pred_lon, 1e1 + value/25e0 as true_lat, 12e1 + (event_id % 47)/5e0 as true_lon,
        6*(1 + event_id % 40) as lead_h, concat(cast(user_id % 10 as varchar(20)),'-',cast(event_id % 40 as varchar(20))) as eval_key, event_id from {events}""",
    "fx_rows": "select vec_id as field_id, label as lat_i, 81e0 - 18e0*label as lat, embedding as vals from {embeddings}",
    # A member is an order's line; the cell is the order, its total the truth.
    "fx_members": """select o_orderpriority as model, o_orderkey as cell, l_linenumber as member, l_extendedprice as pred, o_totalprice/3e0 as truth, 8e1 - 16e0*(o_custkey % 10) as lat from {lineitem} join {orders} on l_orderkey = o_orderkey""",
    # Masks of all lines, by month, quantity and block of orders: the grid widens with the table, its cells stay as full.
    "fx_wide_mask": """select distinct cast(12*(year(l_shipdate) - 1992) + month(l_shipdate) as int) as day, cast(l_quantity as int) as lat_i, cast(floor(l_orderkey/25e1) as int) as lon_i from {lineitem}""",
    "fx_mask": """select distinct cast(12*(year(l_shipdate) - 1992) + month(l_shipdate) as int) as day, cast(l_quantity as int) as lat_i, cast(floor(l_orderkey/5e1) as int) as lon_i from {lineitem}""",
    # Fields of all lines on a 24 x 36 grid, one for each model and 15,000 orders: their number grows with the table.
    "fx_grid": """select concat(l_returnflag, '-', cast(cast(floor(l_orderkey/15e3) as int) as varchar(20))) as model, cast(l_suppkey % 24 as int) as lat_i, cast(l_orderkey % 36 as int) as lon_i, avg(l_extendedprice) as value, avg(l_quantity) as u, avg(l_tax*1e2) as v, avg(l_extendedprice*(1-l_discount)) as truth from {lineitem} group by 1, 2, 3""",
}
NEEDS = {"fx_daily": ("fx_cell_day",), "fx_cell_day": ("lineitem",), "fx_station_obs": ("events",), "fx_track": ("events",), "fx_rows": ("embeddings",), "fx_members": ("lineitem", "orders"), "fx_mask": ("lineitem",), "fx_wide_mask": ("lineitem",), "fx_grid": ("lineitem",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in NEEDS[name]})


def with_views(sql: str, *names: str) -> str:
    """``sql`` (that starts with further CTEs or SELECT) with the named views before it."""
    found: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in found:
            for n in NEEDS[name]:
                add(n)
            found[name] = VIEWS[name].format(**{n: n for n in NEEDS[name]})

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({q})" for n, q in found.items())
    sql = sql.strip()
    if not found:
        return sql
    return f"WITH RECURSIVE {ctes},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes}\n{sql}"
