"""Queries over keyed tables: schema change, backfill, parity, integrity, reconcile."""

from __future__ import annotations

from pyspark.sql import functions as F

from changeguard.functions.columns import clean_identifier, grade, index_name, key_bucket, shorten
from changeguard.operators import backfill as bf
from changeguard.operators import digests
from changeguard.operators import integrity, parity, reconcile, schema_change
from changeguard.plans.plan import ColumnSpec
from changeguard.session import scratch_dir
from changeguard.sources.logs import append_log, read_log, write_report_csv
from changeguard.sources.tables import load_table, observed_schema
from suite.base import SIZE_CLASS, check, rounded

TIER = "CASE WHEN amount < 100000 THEN 'small' WHEN amount < 300000 THEN 'medium' ELSE 'large' END"
BAND = "concat('b', cast(id % 10 AS string))"
ADDED = [ColumnSpec("weight_g", "double"), ColumnSpec("weight", "int"), ColumnSpec("note", "string")]


@check("SELECT p_brand, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY p_brand")
def load_table_scan(i):
    return load_table(i.spark, f"{i.dir}/part.parquet").groupBy("p_brand").agg(
        F.count("*").alias("n"), F.min("p_partkey").alias("first_key"))


@check("""
    SELECT * FROM (
      SELECT 1 AS ordinal, 'o_orderkey' AS column_name, 'bigint' AS data_type, count(*) FILTER (WHERE o_orderkey IS NULL) AS null_count, count(*) AS row_count FROM orders_dst UNION ALL
      SELECT 2, 'o_custkey', 'bigint', count(*) FILTER (WHERE o_custkey IS NULL), count(*) FROM orders_dst UNION ALL
      SELECT 3, 'o_totalprice', 'double', count(*) FILTER (WHERE o_totalprice IS NULL), count(*) FROM orders_dst UNION ALL
      SELECT 4, 'o_orderpriority', 'string', count(*) FILTER (WHERE o_orderpriority IS NULL), count(*) FROM orders_dst)
""", "orders_dst")
def describe_observed(i):
    return observed_schema(i.orders_dst)


@check(f"SELECT id, {SIZE_CLASS} AS shipping_class FROM drift_target", "drift_target")
def derive_column(i):
    return schema_change.derive(i.drift_target, "shipping_class", SIZE_CLASS).select("id", "shipping_class")


@check(f"SELECT id, {TIER} AS tier, {BAND} AS band FROM backfill_target", "backfill_target")
def derive_many_columns(i):
    return schema_change.derive_many(i.backfill_target, {"tier": TIER, "band": BAND}).select("id", "tier", "band")


@check("SELECT id, amount FROM backfill_target WHERE tier IS NULL AND id > 1000", "backfill_target")
def pending_rows(i):
    return bf.pending(i.backfill_target, "tier", "id", 1000).select("id", "amount")


@check("SELECT id, tier, band FROM backfill_target WHERE tier IS NULL OR band IS NULL", "backfill_target")
def pending_any_rows(i):
    return bf.pending_any(i.backfill_target, ["tier", "band"]).select("id", "tier", "band")


@check(f"""SELECT id, CASE WHEN tier IS NULL THEN {TIER} ELSE tier END AS tier,
           CASE WHEN band IS NULL THEN {BAND} ELSE band END AS band FROM backfill_target""", "backfill_target")
def fill_pending_rows(i):
    return bf.fill_pending(i.backfill_target, {"tier": TIER, "band": BAND}).select("id", "tier", "band")


@check("""SELECT id, weight, brand, legacy_shipping, shipping_class, cast(NULL AS double) AS weight_g,
          cast(NULL AS varchar) AS note FROM drift_target""", "drift_target")
def expand_columns(i):
    return schema_change.expand(i.drift_target, ADDED)


@check(f"""SELECT id, weight, brand, coalesce(shipping_class, {SIZE_CLASS}) AS shipping_class FROM drift_target""", "drift_target")
def contract_columns(i):
    filled = bf.fill_pending(i.drift_target, {"shipping_class": SIZE_CLASS})
    return schema_change.contract(filled, ["legacy_shipping"], ["shipping_class", "id"])


@check("SELECT id, brand, legacy_shipping, shipping_class FROM drift_target", "drift_target")
def rollback_columns(i):
    out = schema_change.rollback(schema_change.expand(i.drift_target, ADDED), ADDED)
    left = schema_change.verify_rollback(out, [s.name for s in ADDED])
    if left:
        raise schema_change.ChangeError(f"still there: {left}")
    return out


@check("""
    SELECT 'p_name' AS column_name, 'int' AS target_type, count(p_name) AS value_count, count(*) FILTER (WHERE p_name IS NOT NULL AND try_cast(p_name AS int) IS NULL) AS failed, count(*) FILTER (WHERE p_name IS NOT NULL AND try_cast(p_name AS int) IS NULL) = 0 AS passed FROM part
    UNION ALL
    SELECT 'p_partkey', 'smallint', count(p_partkey), count(*) FILTER (WHERE p_partkey > 32767), count(*) FILTER (WHERE p_partkey > 32767) = 0 FROM part
    UNION ALL
    SELECT 'p_size', 'string', count(p_size), 0, true FROM part""")
def cast_failure_check(i):
    return schema_change.cast_failures(i.table("part"), {"p_name": "int", "p_partkey": "smallint", "p_size": "string"})


@check("""SELECT brand, count(*) AS n, count(*) FILTER (WHERE shipping_class IS NULL) AS nulls,
          cast(sum(weight) AS bigint) AS weight, CASE WHEN count(shipping_class) * 1.0 / count(*) >= 0.999 THEN 'ok'
          WHEN count(shipping_class) * 1.0 / count(*) >= 0.99 THEN 'warn' ELSE 'danger' END AS level
          FROM drift_target GROUP BY brand""", "drift_target")
def grade_fill_level(i):
    per = i.drift_target.groupBy("brand").agg(
        F.count("*").alias("n"), F.count_if(F.col("shipping_class").isNull()).alias("nulls"),
        F.sum("weight").alias("weight"), F.count("shipping_class").alias("_f"))
    return per.withColumn("level", grade(F.col("_f") / F.col("n"), 0.999, 0.99)).drop("_f")


@check("""SELECT doc_id, regexp_replace(trim(source), '[^A-Za-z0-9_]', '', 'g') AS clean,
          CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short,
          substr('idx_' || source || '_' || lang, 1, 63) AS idx,
          regexp_matches(source, '^[A-Za-z_][A-Za-z0-9_]*$') AS valid FROM documents""")
def identifier_text(i):
    from changeguard.functions.columns import is_identifier

    return i.table("documents").select(
        "doc_id", clean_identifier("source").alias("clean"), shorten("text", 100).alias("short"),
        index_name("source", "lang").alias("idx"), is_identifier("source").alias("valid"))


DRIFT = f"""SELECT count(*) AS total, count(*) FILTER (WHERE shipping_class IS NULL) AS nulls,
    count(*) FILTER (WHERE shipping_class IS DISTINCT FROM ({SIZE_CLASS})) AS drifted FROM drift_target"""


@check(f"SELECT total, nulls, drifted, round((total - drifted)::double / total, 6) AS parity FROM ({DRIFT})", "drift_target")
def drift_scan(i):
    return rounded(parity.drift_scan(i.drift_target, "shipping_class", SIZE_CLASS))


@check("""SELECT brand, count(*) AS total, count(*) FILTER (WHERE shipping_class IS NULL) AS nulls,
    count(*) FILTER (WHERE drifted) AS drifted, round(1 - count(*) FILTER (WHERE drifted)::double / count(*), 6) AS parity
    FROM drift_rows GROUP BY brand""", "drift_target drift_rows")
def drift_scan_by_group(i):
    return rounded(parity.drift_scan(i.drift_target, "shipping_class", SIZE_CLASS, ["brand"]))


@check("""SELECT count(*) FILTER (WHERE NOT drifted) AS matches, count(*) AS sampled,
    round(count(*) FILTER (WHERE NOT drifted)::double / count(*), 6) AS parity FROM drift_rows
    WHERE ('0x' || substr(md5('s1' || coalesce(cast(id AS varchar), '')), 1, 8))::bigint < 1073741824""", "drift_target drift_rows")
def sampled_parity(i):
    return rounded(parity.sampled_parity(i.drift_target, "shipping_class", SIZE_CLASS, "id", 0.25, "s1"))


@check("""SELECT count(*) FILTER (WHERE NOT drifted) AS matches, count(*) AS sampled,
    CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE NOT drifted)::double / count(*), 6) ELSE 1 END AS parity FROM
    (SELECT shipping_class IS DISTINCT FROM (CASE WHEN weight < 10 THEN 'light' WHEN weight < 30 THEN 'standard' ELSE 'freight' END) AS drifted,
      ('0x' || substr(md5('s1' || coalesce(CASE WHEN id % 5 > 0 THEN cast(id AS varchar) END, '')), 1, 8))::bigint AS h FROM drift_target)
    WHERE h < 343597""", "drift_target")
def sampled_parity_small_rate(i):
    """A rate of 0.00008, and a fifth of the keys NULL."""
    keyed = i.drift_target.withColumn("id", F.expr("CASE WHEN id % 5 > 0 THEN id END"))
    return rounded(parity.sampled_parity(keyed, "shipping_class", SIZE_CLASS, "id", 0.00008, "s1"))


@check("""SELECT 'shipping_class' AS column_name, count(*) AS total, 0::bigint AS sampled, false AS passed, 'none of ' || count(*) || ' rows sampled' AS reason FROM drift_target""", "drift_target")
def parity_gate_of_nothing(i):
    """A sample without a row must not pass."""
    filled = i.drift_target.withColumn("shipping_class", F.expr(SIZE_CLASS))
    report = parity.verify_columns(filled, {"shipping_class": SIZE_CLASS}, "id", 1e-12, "s1")
    return parity.parity_gate(report).select("column_name", "total", "sampled", "passed", "reason")


TWO = {"shipping_class": SIZE_CLASS, "legacy_shipping": "concat('legacy-tier-', cast(id % 3 AS string))"}


@check(f"""SELECT 'shipping_class' AS column_name, total, nulls, drifted, round((total - drifted)::double / total, 6) AS parity FROM ({DRIFT})
    UNION ALL SELECT 'legacy_shipping', count(*), 0, 0, 1.0::double FROM drift_target""", "drift_target")
def drift_scan_of_columns(i):
    return rounded(parity.drift_columns(i.drift_target, TWO))


@check("""SELECT 'shipping_class' AS column_name, count(*) AS total, count(*) FILTER (WHERE shipping_class IS NULL) AS nulls, count(*) FILTER (WHERE s) AS sampled, count(*) FILTER (WHERE s AND NOT drifted) AS matches,
      round(count(*) FILTER (WHERE s AND NOT drifted)::double / count(*) FILTER (WHERE s), 6) AS parity FROM r
    UNION ALL SELECT 'legacy_shipping', count(*), 0, count(*) FILTER (WHERE s), count(*) FILTER (WHERE s), 1.0::double FROM r""".replace("FROM r", "FROM (SELECT *, ('0x' || substr(md5('s1' || coalesce(cast(id AS varchar), '')), 1, 8))::bigint < 1073741824 AS s FROM drift_rows)"),
       "drift_target drift_rows")
def verify_sampled_columns(i):
    return rounded(parity.verify_columns(i.drift_target, TWO, "id", 0.25, "s1"))


@check(f"""SELECT brand, total, nulls, drifted, round(parity, 6) AS parity, nulls = 0 AND parity >= 0.999 AS passed,
    CASE WHEN nulls > 0 THEN nulls || ' rows still NULL' WHEN parity < 0.999 THEN printf('parity %.5f < 0.99900', parity) END AS reason
    FROM (SELECT brand, count(*) AS total, count(*) FILTER (WHERE shipping_class IS NULL) AS nulls,
    count(*) FILTER (WHERE drifted) AS drifted, (count(*) - count(*) FILTER (WHERE drifted))::double / count(*) AS parity
    FROM drift_rows GROUP BY brand)""", "drift_target drift_rows")
def parity_gate(i):
    report = parity.drift_scan(i.drift_target, "shipping_class", SIZE_CLASS, ["brand"])
    return rounded(parity.parity_gate(report, 0.99, 0.999))


@check("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(i):
    return integrity.duplicate_keys(i.table("lineitem"), ["l_orderkey", "l_linenumber"])


@check("SELECT count(*) FILTER (WHERE status = 'pending') AS unprocessed FROM backfill_target", "backfill_target")
def unprocessed_rows(i):
    return integrity.unprocessed(i.backfill_target)


@check("""
    SELECT 'duplicate_keys' AS check, count(*) AS offences, count(*) = 0 AS passed FROM (SELECT id FROM backfill_target GROUP BY id HAVING count(*) > 1)
    UNION ALL SELECT 'unprocessed:status', count(*), count(*) = 0 FROM backfill_target WHERE status = 'pending'
    UNION ALL SELECT 'null:tier', count(*), count(*) = 0 FROM backfill_target WHERE tier IS NULL
    UNION ALL SELECT 'null:amount', count(*), count(*) = 0 FROM backfill_target WHERE amount IS NULL""", "backfill_target")
def integrity_report(i):
    return integrity.integrity_report(i.backfill_target, "id", ("status", "pending"), ["tier", "amount"])


@check("SELECT o_orderkey, o_custkey FROM orders_dst WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)", "orders_dst")
def orphan_rows(i):
    return integrity.orphans(i.orders_dst, i.table("customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


PAIRED = """(SELECT coalesce(s.o_orderkey, d.o_orderkey) AS o_orderkey, s.o_orderkey IS NOT NULL AS in_s, d.o_orderkey IS NOT NULL AS in_d,
    (s.o_custkey IS DISTINCT FROM d.o_custkey)::int + (s.o_totalprice IS DISTINCT FROM d.o_totalprice)::int
      + (s.o_orderpriority IS DISTINCT FROM d.o_orderpriority)::int AS diff,
    ((s.o_custkey IS NULL) <> (d.o_custkey IS NULL))::int + ((s.o_totalprice IS NULL) <> (d.o_totalprice IS NULL))::int
      + ((s.o_orderpriority IS NULL) <> (d.o_orderpriority IS NULL))::int AS nul
    FROM orders s FULL OUTER JOIN orders_dst d ON s.o_orderkey = d.o_orderkey)"""
RECONCILED = f"""SELECT o_orderkey, CASE WHEN NOT in_d THEN 'missing' WHEN NOT in_s THEN 'extra' WHEN diff > 0 THEN 'changed' ELSE 'same' END AS status,
    CASE WHEN in_s AND in_d THEN diff ELSE 0 END AS changed_columns, CASE WHEN in_s AND in_d THEN nul ELSE 0 END AS null_mismatches FROM {PAIRED}"""
COMPARED = ["o_custkey", "o_totalprice", "o_orderpriority"]


@check(RECONCILED, "orders_dst")
def reconcile_rows(i):
    return reconcile.reconcile(i.table("orders"), i.orders_dst, ["o_orderkey"], COMPARED)


@check(f"SELECT * FROM ({RECONCILED}) WHERE status <> 'same'", "orders_dst")
def reconcile_ranges(i):
    """Digests of key ranges first; only ranges that differ are compared row by row."""
    return digests.reconcile_ranges(i.table("orders"), i.orders_dst, "o_orderkey", COMPARED)


@check(f"SELECT status, count(*) AS keys, cast(sum(null_mismatches) AS bigint) AS null_mismatches FROM ({RECONCILED}) GROUP BY status", "orders_dst")
def reconcile_counts(i):
    return reconcile.reconcile_summary(reconcile.reconcile(i.table("orders"), i.orders_dst, ["o_orderkey"], COMPARED))


def _sum_sql(table):
    def part(c):
        return f"coalesce(length({c}) || ':' || {c}, '-')"

    text = " || '|' || ".join([
        part("cast(o_orderkey AS varchar)"), part("cast(o_custkey AS varchar)"),
        part("cast(cast(round(o_totalprice * 10000) AS hugeint) AS varchar)"), part("o_orderpriority")])
    return f"SELECT count(*) AS row_count, cast(sum(('0x' || substr(md5({text}), 1, 8))::bigint) AS varchar) AS checksum FROM {table}"


SUMMED = ["o_orderkey", *COMPARED]


@check(f"SELECT 'src' AS side, * FROM ({_sum_sql('orders')}) UNION ALL SELECT 'dst', * FROM ({_sum_sql('orders_dst')})", "orders_dst")
def table_checksum_md5(i):
    a = reconcile.table_checksum(i.table("orders"), SUMMED, "md5").select(F.lit("src").alias("side"), "*")
    return a.unionByName(reconcile.table_checksum(i.orders_dst, SUMMED, "md5").select(F.lit("dst").alias("side"), "*"))


@check("""SELECT count(*) AS row_count, true AS same_in_other_order, (SELECT count(*) FROM orders_dst) AS copy_rows, false AS same_as_copy FROM orders""", "orders_dst")
def table_checksum_crc32(i):
    """The other engine has no CRC32: the sums must agree in any order and differ from the damaged copy."""
    a, b, c = (reconcile.table_checksum(df, SUMMED, "crc32") for df in (
        i.table("orders"), i.table("orders").repartition(7, "o_orderdate").sortWithinPartitions(F.desc("o_totalprice")), i.orders_dst))
    sums = a.select("row_count", F.col("checksum").alias("a"), F.lit(1).alias("k")).join(b.select(F.col("checksum").alias("b"), F.lit(1).alias("k")), "k")
    sums = sums.join(c.select(F.col("row_count").alias("copy_rows"), F.col("checksum").alias("c"), F.lit(1).alias("k")), "k")
    return sums.select("row_count", (F.col("a") == F.col("b")).alias("same_in_other_order"), "copy_rows", (F.col("a") == F.col("c")).alias("same_as_copy"))


@check(f"""WITH s AS ({_sum_sql('orders')}), d AS ({_sum_sql('orders_dst')}),
    n AS (SELECT sum(null_mismatches)::bigint AS x FROM ({RECONCILED})),
    f AS (SELECT count(*) AS x FROM orders_dst WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)),
    c AS (SELECT count(*) FILTER (WHERE o_custkey > 32767) AS x FROM orders_dst),
    r AS (SELECT 'row_count' AS check, s.row_count::varchar AS source_value, d.row_count::varchar AS dest_value, s.row_count = d.row_count AS passed FROM s, d
      UNION ALL SELECT 'checksum', s.checksum, d.checksum, s.checksum = d.checksum FROM s, d
      UNION ALL SELECT 'null_values', '0', x::varchar, x = 0 FROM n
      UNION ALL SELECT 'type_conversion', '0', x::varchar, x = 0 FROM c
      UNION ALL SELECT 'fk_integrity', '0', x::varchar, x = 0 FROM f)
    SELECT * FROM r UNION ALL SELECT 'overall', NULL, NULL, bool_and(passed) FROM r""", "orders_dst")
def parity_report(i):
    return reconcile.parity_report(
        i.table("orders"), i.orders_dst, ["o_orderkey"], COMPARED, {"o_custkey": "smallint"},
        [("o_custkey", i.table("customer"), "c_custkey")], "md5")


@check("""SELECT coalesce(min(id), 0) AS min_key, coalesce(max(id), 0) AS max_key, count(id) = 0 AS is_empty FROM backfill_target""", "backfill_target")
def key_bounds(i):
    return bf.key_bounds(i.backfill_target)


@check("""SELECT remaining, done, remaining + done AS total, round(done * 100.0 / (remaining + done), 6)::double AS pct
    FROM (SELECT count(*) FILTER (WHERE tier IS NULL) AS remaining, count(tier) AS done FROM backfill_target)""", "backfill_target")
def backfill_status(i):
    return rounded(bf.backfill_status(i.backfill_target, "tier"))


CHECKPOINTS = """SELECT o_orderkey AS id, o_custkey % 50 AS migration_id,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('{{"last_id": ', cast(o_orderkey AS string), ', "rows_done": ', cast(o_orderkey * 2 AS string), ', "batch_num": ', cast(o_orderkey % 100 AS string), '}}')
         WHEN o_orderkey % 3 = 1 THEN concat('{{"canary_pct": ', cast(o_orderkey % 101 AS string), ', "slo_breach": "p99 ', cast(o_orderkey % 7 AS string), 'ms"}}') ELSE 'no json' END AS detail
    FROM {orders}"""


@check("""SELECT migration_id, max(id) FILTER (WHERE id % 3 = 0) AS last_id, max(id) FILTER (WHERE id % 3 = 0) * 2 AS rows_done, (max(id) FILTER (WHERE id % 3 = 0) % 100)::int AS batch_num,
    (max(id) FILTER (WHERE id % 3 = 1) % 101)::int AS canary_pct, 'p99 ' || (max(id) FILTER (WHERE id % 3 = 1) % 7) || 'ms' AS slo_breach, NULL::double AS cutover_parity
    FROM (SELECT o_orderkey AS id, o_custkey % 50 AS migration_id FROM orders) GROUP BY migration_id""")
def read_checkpoints(i):
    return bf.read_checkpoints(i.spark.sql(CHECKPOINTS, orders=i.table("orders")))


@check("""WITH p AS (SELECT max(o_orderkey) AS id FROM orders WHERE o_custkey % 50 = 7 AND o_orderkey % 3 = 0)
    SELECT remaining, done, remaining + done AS total, round(done * 100.0 / (remaining + done), 6)::double AS pct
    FROM (SELECT (SELECT count(*) FROM backfill_target, p WHERE tier IS NULL AND backfill_target.id > p.id) AS remaining, id * 2 AS done FROM p)""", "backfill_target")
def backfill_status_from_checkpoints(i):
    events = i.spark.sql(CHECKPOINTS, orders=i.table("orders"))
    return rounded(bf.status_from_checkpoints(i.backfill_target, "tier", events, "7"))


@check("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def batch_membership(i):
    ids = i.table("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return bf.in_batch(i.table("orders"), ids, "o_orderkey").select("o_orderkey", "o_orderdate")


@check("""SELECT n AS batch_number, min(id) AS first_key, max(id) AS last_key, count(*) AS row_count,
    cast(sum(count(*)) OVER (ORDER BY n) AS bigint) AS running_rows
    FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 700 + 1 AS n FROM backfill_target WHERE tier IS NULL) GROUP BY n""", "backfill_target")
def plan_batches(i):
    return bf.plan_batches(i.backfill_target, "tier", "id", 700)


@check("""SELECT n AS batch_number, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key, count(*) AS row_count,
    cast(sum(count(*)) OVER (ORDER BY n) AS bigint) AS running_rows
    FROM (SELECT l_orderkey, (row_number() OVER (ORDER BY l_orderkey) - 1) // 5000 + 1 AS n FROM lineitem) GROUP BY n""")
def plan_batches_repeated_keys(i):
    rows = i.table("lineitem").withColumn("filled", F.lit(None).cast("string"))
    return bf.plan_batches(rows, "filled", "l_orderkey", 5000, ["l_linenumber", "l_partkey", "l_suppkey"])


@check("""SELECT shard::int AS shard, min(id) AS first_key, max(id) AS last_key, count(*) AS row_count, count(*) FILTER (WHERE status = 'pending') AS pending_rows
    FROM (SELECT *, least((id - lo) // greatest((hi - lo + 1) // 16, 1), 15) AS shard FROM backfill_target, (SELECT min(id) AS lo, max(id) AS hi FROM backfill_target))
    GROUP BY shard""", "backfill_target")
def shard_report(i):
    return bf.shard_report(i.backfill_target, "id", 16, F.col("status") == "pending")


@check("""SELECT table_id, row_count, target_s, batch_s, greatest(1, least(64, (row_count // 10000) // greatest(floor(target_s / batch_s)::bigint, 1)))::int AS shards
    FROM table_stats""", "table_stats")
def optimal_shards(i):
    return bf.optimal_shards(i.table_stats, "row_count", "target_s", "batch_s")


@check("SELECT id FROM backfill_target WHERE tier IS NULL AND id > 500 ORDER BY id LIMIT 1000", "backfill_target")
def next_batch(i):
    return bf.next_batch(i.backfill_target, "tier", "id", 500, 1000)


@check("""SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE WHEN sum(d) > 0 THEN 'only_in_a' ELSE 'only_in_b' END AS side, abs(sum(d))::bigint AS copies
    FROM (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, 1 AS d FROM orders UNION ALL SELECT *, -1 FROM orders_dst)
    GROUP BY ALL HAVING sum(d) <> 0""", "orders_dst")
def row_difference(i):
    return reconcile.row_diff(i.table("orders").select("o_orderkey", *COMPARED), i.orders_dst)


@check("""SELECT 'shipping_class' AS column_name, 'dropped' AS change, 'string' AS old_type, NULL AS new_type, count(shipping_class) AS affected_values FROM drift_target
    UNION ALL SELECT 'weight', 'retyped', 'int', 'bigint', count(weight) FROM drift_target
    UNION ALL SELECT 'note', 'added', NULL, 'string', 0""", "drift_target")
def schema_difference(i):
    a = i.drift_target
    b = schema_change.expand(a.drop("shipping_class").withColumn("weight", F.col("weight").cast("bigint")), [ColumnSpec("note")])
    values = observed_schema(a).select("column_name", (F.col("row_count") - F.col("null_count")).alias("_n"))
    return schema_change.schema_diff(a, b).join(values, "column_name", "left").select(
        "column_name", "change", "old_type", "new_type", F.coalesce("_n", F.lit(0)).alias("affected_values"))


@check("""SELECT b // 1000 AS decile, count(*) AS n FROM (SELECT ('0x' || substr(md5('x' || cast(o_orderkey AS varchar)), 1, 8))::bigint % 10000 AS b FROM orders) GROUP BY 1""")
def key_buckets(i):
    b = key_bucket("o_orderkey", "x")
    return i.table("orders").groupBy(F.floor(b / 1000).alias("decile")).agg(F.count("*").alias("n"))


@check("SELECT migration_id::varchar AS migration_id, to_state, count(*) AS n FROM state_log GROUP BY ALL", "state_log")
def append_and_read_events(i):
    path = scratch_dir(i.spark, "events")
    log = i.state_log
    back = F.col("to_state").isin("RollingBack", "RolledBack")
    append_log(log.filter(~back), path, "state")
    append_log(log.filter(back), path, "state")
    return read_log(i.spark, path, "state").groupBy("migration_id", "to_state").agg(F.count("*").alias("n"))


@check("SELECT stage, count(*) AS n, cast(sum(rows_affected) AS bigint) AS row_total FROM batch_log GROUP BY stage", "batch_log")
def report_csv_round_trip(i):
    path = scratch_dir(i.spark, "report")
    write_report_csv(i.batch_log.groupBy("stage").agg(F.count("*").alias("n"), F.sum("rows_affected").alias("row_total")), path)
    return i.spark.read.schema("stage string, n long, row_total long").option("header", True).csv(path)
