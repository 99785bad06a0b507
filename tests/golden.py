"""A small corpus written as the star-schema tables that the adapter reads."""

from __future__ import annotations

from datetime import datetime

import pandas as pd


def write(folder: str) -> None:
    orders = pd.DataFrame([(i, i % 3, "OFP"[i % 3], 10_000.0 * (i % 13), datetime(1995 + i % 7, 1, 2), f"{i % 5}-X") for i in range(40)], columns="o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split())
    lines = [(i, (i * k + k) % 12, (i + k) % 5, k) for i in range(38) for k in range(1, 4)]
    lineitem = pd.DataFrame([(o, p, s, n, 1.0, 2.0, 0.0, 0.0, "A", "F", datetime(1998, 1, 1)) for o, p, s, n in lines], columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())
    names = ["red widget", "blue bolt", "small ring", "green gear"]
    part = pd.DataFrame([(i, names[i % 4], f"Brand#{i % 3}", ["ECONOMY", "PROMO", "STANDARD"][i % 3], i, 1.0) for i in range(12)], columns="p_partkey p_name p_brand p_type p_size p_retailprice".split())
    supplier = pd.DataFrame([(i, f"Supplier#{i:09d}", i % 2, 1.0) for i in range(5)], columns="s_suppkey s_name s_nationkey s_acctbal".split())
    nation = pd.DataFrame([(0, "N0", 0), (1, "N1", 1)], columns="n_nationkey n_name n_regionkey".split())
    region = pd.DataFrame([(0, "ASIA"), (1, "EUROPE")], columns="r_regionkey r_name".split())
    customer = pd.DataFrame([(i, f"C{i}", 0, 1.0, "SEG") for i in range(3)], columns="c_custkey c_name c_nationkey c_acctbal c_mktsegment".split())
    for name, df in locals().items():
        if isinstance(df, pd.DataFrame):
            df.to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us")
