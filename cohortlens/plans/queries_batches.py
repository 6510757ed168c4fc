"""Batches of answers over orders, taken in by several calls, combined and finished."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import readers as RD
from . import batch_job as B
from . import roles
from .registry import Registry

QUERIES = Registry()

_SQL = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
offered AS (SELECT (k % 6 + 1)::INT AS batch_no, k, CASE WHEN k % 17 = 0 THEN 'invalid JSON'
    WHEN k % 19 = 0 THEN 'row is not an object' WHEN k % 23 = 0 THEN 'no patient id' END AS reason,
    'O' || k AS patient_id, s AS label FROM o
  UNION ALL SELECT 9, k, NULL, 'O' || k, 'again' FROM o WHERE k % 5 = 0
  UNION ALL SELECT 9, k, NULL, 'Z' || k, 'again' FROM o WHERE k % 29 = 0),
kept AS (SELECT patient_id, min(batch_no) AS batch_no, arg_min(label, batch_no) AS label FROM offered
  WHERE reason IS NULL AND patient_id LIKE 'O%' GROUP BY patient_id)
"""


def _offered(spark, sf_dir):
    """Lines of numbered batches: 1 to 6 hold an order each, 9 offers every fifth again and unknown ones."""
    orders = roles.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    k = F.col("k")

    def text(kind, label):
        return F.to_json(F.struct(F.concat(F.lit(kind), k).alias("patient_id"), label.alias("label")))

    own = text("O", F.col("o_orderstatus"))
    first = (F.when(k % 17 == 0, F.concat(own, F.lit("}"))).when(k % 19 == 0, F.concat(F.lit("["), own, F.lit("]")))
             .when(k % 23 == 0, F.to_json(F.struct(F.col("o_orderstatus").alias("label")))).otherwise(own))
    again = F.lit("again")
    return orders.select((k % 6 + 1).cast("int").alias("batch"), first.alias("value")).unionByName(
        orders.where("k % 5 = 0").select(F.lit(9).alias("batch"), text("O", again).alias("value"))).unionByName(
        orders.where("k % 29 = 0").select(F.lit(9).alias("batch"), text("Z", again).alias("value")))


def _finished(spark, sf_dir):
    """The later batches come first, one call is repeated, and all are offered once more at the end."""
    source, folder, out = (scratch_path(spark, x) for x in ("offered", "job", "finished"))
    _offered(spark, sf_dir).write.partitionBy("batch").text(source)
    B.create(spark, folder)
    for pattern in ("batch=[49]", "batch=[49]", "batch=*"):
        B.ingest(RD.read_batch_lines(spark, f"{source}/{pattern}"), folder)
    expected = roles.table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), "o_orderkey").alias("patient_id"))
    return B.finalize(spark, folder, expected, out, fatal=()), out


@QUERIES.add("batch_records", "LBL-12 SRC-06", _SQL + """
SELECT 'O' || k AS patient_id, coalesce(batch_no, 0)::INT AS batch_no, label, CASE WHEN label IS NULL THEN 'missing' ELSE 'labelled' END AS status
FROM o LEFT JOIN kept ON kept.patient_id = 'O' || k""")
def batch_records(spark, sf_dir):
    """The record of every order after all calls; batch 0 where there is none."""
    _, out = _finished(spark, sf_dir)
    return spark.read.parquet(f"{out}/records").select(
        "patient_id", F.coalesce("batch_no", F.lit(0)).alias("batch_no"), F.get_json_object("record", "$.label").alias("label"), "status")


@QUERIES.add("batch_summary", "LBL-12", _SQL + """,
outcomes AS (SELECT CASE WHEN label IS NULL THEN 'missing' ELSE 'labelled' END AS outcome
  FROM o LEFT JOIN kept ON kept.patient_id = 'O' || k
  UNION ALL SELECT coalesce(reason, CASE WHEN f.patient_id LIKE 'Z%' THEN 'unknown patient'
    WHEN f.batch_no <> kept.batch_no THEN 'repeated patient' END) FROM offered f LEFT JOIN kept USING (patient_id))
SELECT outcome, count(*) AS n FROM outcomes WHERE outcome IS NOT NULL GROUP BY outcome""")
def batch_summary(spark, sf_dir):
    """What became of the orders and of the lines that were offered."""
    return _finished(spark, sf_dir)[0]
