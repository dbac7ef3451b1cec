import os
from datetime import datetime

from forja.catalog import inputs, model_queries
from forja.staging import out_dir

DAY = datetime(2024, 3, 5)
TABLES = {
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                 "l_discount double, l_tax double, l_shipdate timestamp_ntz",
                 [(1, 5, 1, 1, 10.0, 5000.0, 0.1, 0.02, DAY), (1, 6, 2, 2, 20.0, 7000.0, 0.0, 0.02, DAY), (2, 7, 1, 1, 5.0, 900.0, 0.2, 0.02, DAY)]),
    "orders": ("o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz", [(1, 1, 900.0, DAY), (1, 1, 4000.0, DAY)]),
    "customer": ("c_custkey long, c_mktsegment string", [(1, "AUTO")]),
    "supplier": ("s_suppkey long, s_nationkey int", [(1, 1), (2, 1)]),
    "nation": ("n_nationkey int, n_regionkey int", [(1, 1)]),
    "region": ("r_regionkey int, r_name string", [(1, "EUROPE")]),
    "part": ("p_partkey long, p_type string, p_size int", [(1, "STEEL", 7), (2, "TIN", 9)]),
}


def test_fact_joins_orders_only_where_they_are_named(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    sf = str(tmp_path)
    fact = inputs.fact(spark, sf)
    rows = {(r["work_order_id"], r["op_id"]): r for r in fact.collect()}
    assert {k: (r["qty_plan"], r["cliente"], r["planta"]) for k, r in rows.items()} == {
        ("000000000001", "CURV10"): (40, "AUTO", "EUROPE"), ("000000000001", "TALL20"): (40, "AUTO", "EUROPE"),
        ("000000000002", "CURV10"): (None, None, "EUROPE")}
    lean = fact.groupBy("estado").count()
    assert sum(r["count"] for r in lean.collect()) == 3
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # neither orders nor dimensions are read again
    stored = set(os.listdir(out_dir(spark, sf)))
    assert "operaciones" in stored and not stored & {"produccion", "ordenes", "ordenes_unicas"}


def test_machine_features_of_a_fit_are_read_and_not_derived_again(spark, tmp_path):
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    machines = model_queries.machines(spark, str(tmp_path))
    assert {r["machine_name"] for r in machines.collect()} == {"M00000001", "M00000002"}
    plan = machines._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # a fit of many rounds shuffles no operations
