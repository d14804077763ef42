"""How many sales are open at a time in each nation, and when most are.

Starts and ends become changes by nation and moment. A change's running sums
are found on two levels: within the bucket of its nation and day, and over the
buckets' subtotals, whose scan gives what each bucket carries in. Bucket maxima
and first moments are scanned the same way for the highest value so far, the
nation's peak and the next moment. A task never holds more than a nation's
moments of one day, or one row for each of a nation's days; nothing is
broadcast.

Defined cases. Every row of sales is a sale, also where a sale_id repeats; one
without a sale_id has no lines and stays open. A client that is listed more
than once has its smallest nation that is not null. A total that is null or not
finite counts 0 cents. Lines without sale_id or shipped_at are left out, an
empty table of lines leaves every sale open, and without sales there are no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopyrank.llm.common import materialise

#: Fixed values of the query: seconds of a moment, seconds of a bucket, days that a sale stays open after its last shipment.
STEP, BUCKET, EXTRA_DAYS = 900, 86400, 0
#: Names of "no nation" and "all nations".
NOWHERE, EVERYWHERE = -1, -2


def moment(df: DataFrame, c: str, step: int = STEP) -> Column:
    """UTC seconds since 1970, rounded down. A time without a zone is read as UTC, whatever the session's zone is."""
    if dict(df.dtypes)[c] == "timestamp_ntz":
        seconds = F.unix_date(F.col(c).cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c))
    else:
        seconds = F.unix_seconds(F.col(c).cast("timestamp"))
    return (F.floor(seconds / F.lit(step)) * step).cast("long")


CHANGES = """
WITH ends AS (SELECT sale_id, max(till_s) AS till_s FROM {lines} WHERE sale_id IS NOT NULL AND till_s IS NOT NULL GROUP BY sale_id),
 open AS (SELECT /*+ MERGE(e) */ s.client_id, s.from_s, e.till_s, s.cents FROM {sales} s LEFT JOIN ends e ON e.sale_id = s.sale_id
  WHERE s.from_s IS NOT NULL AND (e.till_s IS NULL OR e.till_s > s.from_s)),
 both AS (SELECT client_id, inline(array(struct(from_s, 1L AS dn, cents AS dc), struct(till_s AS from_s, -1L AS dn, -cents AS dc))) FROM open),
 -- a client with many sales has one row for a moment before its nation is looked up
 moves AS (SELECT client_id, from_s, sum(dn) AS dn, sum(dc) AS dc FROM both WHERE from_s IS NOT NULL GROUP BY client_id, from_s),
 homes AS (SELECT client_id, min(nation_id) AS nation_id FROM {clients} WHERE client_id IS NOT NULL GROUP BY client_id),
 placed AS (SELECT /*+ MERGE(h) */ coalesce(h.nation_id, {nowhere}) AS nation_id, m.from_s, m.dn, m.dc FROM moves m LEFT JOIN homes h ON h.client_id = m.client_id)
SELECT CASE WHEN grouping(nation_id) = 1 THEN {everywhere} ELSE nation_id END AS nation_id, from_s, floor(from_s / {bucket}) AS bucket, sum(dn) AS dn, sum(dc) AS dc
FROM placed GROUP BY GROUPING SETS ((nation_id, from_s), (from_s)) HAVING sum(dn) <> 0 OR sum(dc) <> 0
"""

SWEEP = """
WITH inside AS (SELECT *, sum(dn) OVER w AS rn, sum(dc) OVER w AS rc, lead(from_s) OVER (PARTITION BY nation_id, bucket ORDER BY from_s) AS next_s FROM {changes}
  WINDOW w AS (PARTITION BY nation_id, bucket ORDER BY from_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 buckets AS (SELECT nation_id, bucket, sum(dn) AS sn, sum(dc) AS sc, max(rn) AS top, min(from_s) AS first_s FROM inside GROUP BY nation_id, bucket),
 carries AS (SELECT *, coalesce(sum(sn) OVER p, 0) AS cn, coalesce(sum(sc) OVER p, 0) AS cc FROM buckets
  WINDOW p AS (PARTITION BY nation_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 scanned AS (SELECT nation_id, bucket, cn, cc, max(cn + top) OVER (PARTITION BY nation_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high,
  max(cn + top) OVER (PARTITION BY nation_id) AS peak, lead(first_s) OVER (PARTITION BY nation_id ORDER BY bucket) AS next_s FROM carries)
SELECT /*+ MERGE(s) */ i.nation_id, i.from_s, coalesce(i.next_s, s.next_s) AS to_s, cn + rn AS n_open, cc + rc AS open_cents,
 cn + greatest(max(rn) OVER (PARTITION BY i.nation_id, i.bucket ORDER BY i.from_s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), high - cn) AS high_open, cn + rn = peak AS is_peak
FROM inside i JOIN scanned s ON s.nation_id = i.nation_id AND s.bucket = i.bucket
"""


def changes(sales: DataFrame, lines: DataFrame, clients: DataFrame, step: int = STEP, bucket: int = BUCKET, extra_days: int = EXTRA_DAYS) -> DataFrame:
    """nation_id, from_s, bucket, dn, dc: by how much the open sales and their cents change."""
    cents = F.col("total").cast("double") * 100 + 0.5
    plain = F.col("total").isNotNull() & ~F.isnan(cents) & (F.abs(cents) != float("inf"))
    s = sales.select("sale_id", "client_id", moment(sales, "sold_at", step).alias("from_s"), F.when(plain, F.floor(cents)).otherwise(F.lit(0)).cast("long").alias("cents"))
    # rounding keeps the order, so the latest time is the latest moment; the days are added before rounding
    ends = lines.select("sale_id", (F.col("shipped_at") + F.expr(f"INTERVAL {int(extra_days)} DAY")).alias("till"))
    ends = ends.select("sale_id", moment(ends, "till", step).alias("till_s"))
    return sales.sparkSession.sql(CHANGES, sales=s, lines=ends, clients=clients.select("client_id", F.col("nation_id").cast("int").alias("nation_id")), nowhere=NOWHERE, everywhere=EVERYWHERE, bucket=bucket)


def sweep(found: DataFrame) -> DataFrame:
    """nation_id, from_s, to_s, n_open, open_cents, high_open, is_peak of changes(); read more than once, so written first."""
    return found.sparkSession.sql(SWEEP, changes=materialise(found, "changes"))


def op13(spark, sf_dir) -> DataFrame:
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return sweep(changes(table("sales"), table("sale_lines"), table("clients")))
