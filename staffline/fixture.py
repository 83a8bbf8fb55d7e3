"""Staff and review tables over the driver's test tables (mapping in FIXTURES.md §2).

One order is one employment spell, one line item one review. The mapping is written with the
DataFrame API so Catalyst prunes every scan to the handful of columns it needs; the same
mapping as SQL text (for DuckDB) lives in ``staffline.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import DEFAULT_AS_OF

# The instant every test query is evaluated at (FIXTURES.md).
AS_OF = DEFAULT_AS_OF


# Columns the mapping reads, with their Parquet types: a declared read schema skips footer-based
# inference on the driver and limits the scan to these columns.
READ_SCHEMAS = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, "
              "o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "lineitem": "l_orderkey BIGINT, l_linenumber INT, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(READ_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: F.Column, pairs: list[tuple], default=None) -> F.Column:
    expr = None
    for k, v in pairs:
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # nation is the fixed 25-row TPC-H dimension: broadcasting it is bounded by definition.
    n = F.broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    # One row per order after a partial (map-side) aggregate; joins orders on the same key.
    x = li.groupBy("l_orderkey").agg(
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("exit_date"),
        F.max(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("last_promotion"),
        F.max(F.when(F.col("l_returnflag") == "N", F.col("l_shipdate"))).alias("last_merit"),
    )
    j = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(x, o.o_orderkey == x.l_orderkey, "left")
    )
    key4 = F.col("o_orderkey") % 4
    cust4 = F.col("o_custkey") % 4
    return j.select(
        F.col("o_orderkey").alias("employee_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("department"),
        _case(F.col("o_orderpriority"), [("1-URGENT", "Diretor"), ("2-HIGH", "Gerente"),
                                         ("3-MEDIUM", "Coordenador"), ("5-LOW", "Analista")]).alias("role"),
        F.col("o_custkey").alias("manager_id"),
        _case(F.col("o_orderstatus"), [("F", "CLT"), ("O", "PJ")], "Estágio").alias("contract_type"),
        _case(key4, [(0, "Feminino"), (1, "Masculino"), (2, "M")]).alias("gender"),
        F.col("o_orderdate").alias("hire_date"),
        F.col("exit_date"),
        F.when(F.col("exit_date").isNull(), F.lit(None).cast("string"))
        .when(cust4 == 0, F.lit("Pedido de demissão"))
        .when(cust4 == 1, F.lit("Dispensa"))
        .when(cust4 == 2, F.lit("Aposentadoria"))
        .alias("exit_reason"),
        F.col("last_promotion"),
        F.col("last_merit"),
        F.col("n_name").alias("company"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("employee_id"),
        _case(F.col("l_linenumber") % 5, [(0, "Excepcional"), (1, "Acima do esperado"),
                                          (2, "Dentro do esperado"), (3, "Abaixo do esperado")], "Sem nota").alias("rating"),
        F.col("l_shipdate").alias("cycle_end"),
        F.col("l_linenumber").cast("long").alias("seq"),
    )
