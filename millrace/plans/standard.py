"""Statistics of the standard decision-support tables at scale factor 1, for planning without data."""

from __future__ import annotations

from .statistics import Statistics

# A few of the counts can't be (s_name, s_address and s_phone have more values than rows): estimates that are to agree
# with others made from these constants need them as they are.
# Rows, then distinct values of each column; a column without a known count has 1.
TABLES = {
    "supplier": (10000, {"s_suppkey": 10000, "s_nationkey": 25, "s_acctbal": 9955, "s_name": 100000, "s_address": 100000, "s_phone": 100000, "s_comment": 10000}),
    "partsupp": (800000, {"ps_suppkey": 10000, "ps_partkey": 200000, "ps_availqty": 9999, "ps_supplycost": 99865, "ps_comment": 799123}),
    "lineitem": (
        6001215,
        {
            "l_returnflag": 3, "l_discount": 11, "l_shipmode": 7, "l_orderkey": 1500000, "l_receiptdate": 1, "l_partkey": 200000, "l_suppkey": 10000, "l_linenumber": 7, "l_quantity": 50,
            "l_extendedprice": 933900, "l_tax": 9, "l_linestatus": 2, "l_shipdate": 2526, "l_commitdate": 2466, "l_shipinstruct": 4, "l_comment": 4501941,
        },
    ),
    "orders": (1500000, {"o_custkey": 150000, "o_orderkey": 1500000, "o_orderdate": 2406, "o_totalprice": 1464556, "o_orderstatus": 3, "o_orderpriority": 5, "o_clerk": 1000, "o_shippriority": 1, "o_comment": 1478684}),
    "customer": (150000, {"c_custkey": 150000, "c_nationkey": 25, "c_mktsegment": 5, "c_name": 150000, "c_address": 150000, "c_phone": 150000, "c_acctbal": 140187, "c_comment": 149965}),
    "nation": (25, {"n_nationkey": 25, "n_regionkey": 5, "n_name": 25, "n_comment": 25}),
    "part": (200000, {"p_partkey": 200000, "p_size": 50, "p_container": 40, "p_name": 199996, "p_mfgr": 5, "p_brand": 25, "p_type": 150, "p_retailprice": 20899, "p_comment": 127459}),
    "region": (5, {"r_regionkey": 5, "r_name": 5, "r_comment": 5}),
}


def standard_statistics() -> Statistics:
    out = Statistics()
    for table, (rows, columns) in TABLES.items():
        out.add_rel(table, rows)
        for column, distinct in columns.items():
            out.add_att(table, column, distinct)
    return out
