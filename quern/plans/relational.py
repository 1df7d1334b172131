"""Queries on the plain side of the catalogue, over a ledger made from the order tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import balances, instructions, reports
from ..sources import archive
from .sinks import epoch_of, epochs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: One row per instruction, numbered within its transaction by the five columns that tell lines apart.
IX = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ix, 'P' || (l_suppkey % 7) AS program FROM lineitem)"


def ix_rows(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    keys = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = table(spark, d, "lineitem").select("l_orderkey", *dict.fromkeys([*keys, *columns]))
    order = Window.partitionBy("l_orderkey").orderBy(*keys)
    return rows.withColumn("ix", F.row_number().over(order).cast("long")).withColumn("program", F.concat(F.lit("P"), (F.col("l_suppkey") % 7).cast("string")))


def _text(prefix: str, column: str) -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def transactions(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("ix", F.struct(F.col("program").alias("program_id"), _text("D", "l_partkey").alias("data"), F.array(_text("S", "l_suppkey"), _text("A", "l_partkey")).alias("accounts")).alias("i"))
    lists = ix_rows(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["i"]).alias("instructions"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    empty = F.array().cast("array<struct<program_id:string,data:string,accounts:array<string>>>")
    tx = orders.join(lists, orders.o_orderkey == lists.l_orderkey, "left").withColumn("instructions", F.coalesce("instructions", empty))
    accounts = F.concat(F.array(_text("C", "o_custkey")), F.array_sort(F.array_distinct(F.transform("instructions", lambda i: i["accounts"][0]))))
    return tx.select(
        F.col("o_orderkey").alias("slot"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("block_time"), F.array(_text("sig", "o_orderkey")).alias("signatures"), accounts.alias("accounts"),
        F.round("o_totalprice").cast("long").alias("fee"), F.when(F.col("o_orderstatus") == "F", "InstructionError").alias("err"), "instructions",
        F.slice("instructions", 1, 2).alias("outer"), F.slice("instructions", 3, 1000).alias("inner"), F.array_distinct(F.transform(F.slice("instructions", 1, 3), lambda i: i["program_id"])).alias("static_keys"),
    )


# ---------------------------------------------------------------- filters


@register("SELECT o_orderkey AS slot, (SELECT count(*) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey) AS n_ix FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey % 7 IN (3, 5))")
def program_filter(spark, d):
    tx = transactions(spark, d).where(instructions.runs_program("instructions", ["P3", "P5"]))
    return tx.select("slot", F.size("instructions").cast("long").alias("n_ix"))


@register(f"SELECT DISTINCT l_orderkey AS slot FROM {IX} WHERE ix <= 2 AND program = 'P3'")
def program_filter_outer(spark, d):
    return transactions(spark, d).where(instructions.runs_program("outer", ["P3"])).select("slot")


@register(f"SELECT DISTINCT l_orderkey AS slot FROM {IX} WHERE ix <= 3 AND program = 'P3'")
def prefilter_keys(spark, d):
    return transactions(spark, d).where(instructions.may_run_program("static_keys", ["P3"])).select("slot")


@register(f"SELECT l_orderkey AS slot, count(*) AS n_ix FROM {IX} WHERE l_orderkey IN (SELECT l_orderkey FROM {IX} WHERE ix <= 3 AND program = 'P4') GROUP BY l_orderkey")
def two_phase_filter(spark, d):
    return instructions.two_phase(transactions(spark, d), ["P4"]).select("slot", F.size("instructions").cast("long").alias("n_ix"))


@register("SELECT DISTINCT l_orderkey AS slot FROM lineitem WHERE l_suppkey % 7 = 4")
def strict_lookup_filter(spark, d):
    return instructions.two_phase(transactions(spark, d), ["P4"], strict_lookup=True).select("slot")


@register(f"SELECT l_orderkey AS slot, string_agg(program || ':D' || l_partkey, ',' ORDER BY ix) AS kept FROM {IX} WHERE program NOT IN ('P0', 'P1', 'P2') GROUP BY l_orderkey")
def array_filter_ignore(spark, d):
    kept = instructions.without_programs("instructions", ["P0", "P1", "P2"])
    tx = transactions(spark, d).select("slot", kept.alias("k")).where(F.size("k") > 0)
    return tx.select("slot", F.array_join(F.transform("k", lambda i: F.concat(i["program"], F.lit(":"), i["data"])), ",").alias("kept"))


@register("SELECT o_orderkey AS slot, epoch(o_orderdate)::BIGINT AS block_time, 'sig' || o_orderkey AS tx_id, o_orderstatus = 'F' AS is_error, CASE WHEN o_orderstatus = 'F' THEN 'InstructionError' END AS error_msg, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 7 <> 0) AS n_clean FROM orders")
def tx_clean(spark, d):
    return instructions.clean(transactions(spark, d), ["P0"]).select("slot", "block_time", "tx_id", "is_error", "error_msg", F.size("clean_instructions").cast("long").alias("n_clean"))


@register("SELECT 'sig' || l_orderkey AS tx_id, l_orderkey AS slot, epoch(o_orderdate)::BIGINT AS block_time, 'D' || l_partkey AS b58, 'S' || l_suppkey || '|A' || l_partkey AS accounts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey % 7 = 3")
def flatten_ix(spark, d):
    return instructions.flatten(instructions.clean(transactions(spark, d), ["P0"]), "P3").withColumn("accounts", F.array_join("accounts", "|"))


@register(f"SELECT l_orderkey AS slot, string_agg(DISTINCT program, ',' ORDER BY program) AS program_ids FROM {IX} GROUP BY l_orderkey")
def program_ids(spark, d):
    tx = transactions(spark, d).where(F.size("instructions") > 0)
    return tx.select("slot", F.array_join(F.array_sort(F.array_distinct(F.transform("instructions", lambda i: i["program_id"]))), ",").alias("program_ids"))


@register("""SELECT o_orderkey AS slot FROM orders WHERE (o_custkey % 5 = 0 AND o_custkey BETWEEN 5 AND 500 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey IN (1, 2, 3)))
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey IN (4, 5)) AND o_orderstatus <> 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)""")
def stream_filter(spark, d):
    tx = transactions(spark, d).withColumn("is_error", F.col("err").isNotNull())
    include = [f"C{i}" for i in range(5, 501, 5)] + ["S1", "S2", "S3"]
    return instructions.accounts_filter(tx, include, ["S4", "S5"], ["S7"], failed=False).select("slot")


@register(f"SELECT l_orderkey AS slot, unnest(['payer', 'mint', 'owner'][1:least(count(*), 3)]) AS name, unnest((list('S' || l_suppkey ORDER BY ix))[1:3]) AS account FROM {IX} GROUP BY l_orderkey")
def account_names(spark, d):
    names = F.array(F.lit("payer"), F.lit("mint"), F.lit("owner"))
    tx = transactions(spark, d).where(F.size("instructions") > 0)
    named = instructions.account_names(names, F.transform("instructions", lambda i: i["accounts"][0]))
    return tx.select("slot", F.explode(named).alias("name", "account"))


# ---------------------------------------------------------------- joins


@register(f"""WITH pre AS (SELECT l_orderkey, l_suppkey, arg_max(l_extendedprice, ix) AS pre_amount FROM {IX} WHERE ix % 2 = 1 GROUP BY ALL), post AS (SELECT l_orderkey, l_suppkey, arg_max(l_extendedprice, ix) AS post_amount FROM {IX} WHERE ix % 2 = 0 GROUP BY ALL)
SELECT coalesce(pre.l_orderkey, post.l_orderkey) AS l_orderkey, coalesce(pre.l_suppkey, post.l_suppkey) AS l_suppkey, pre_amount, post_amount FROM pre FULL OUTER JOIN post ON pre.l_orderkey = post.l_orderkey AND pre.l_suppkey = post.l_suppkey""")
def token_delta_full_outer(spark, d):
    rows = ix_rows(spark, d)
    return balances.token_changes(rows.where("ix % 2 = 1"), rows.where("ix % 2 = 0"), "l_orderkey", ["l_suppkey"], "l_extendedprice", "ix")


@register(f"SELECT l_orderkey AS slot, ix - 1 AS idx, CASE WHEN ix <= 3 THEN 'S' || l_suppkey ELSE 'UNKNOWN_ACCOUNT_INDEX_' || (ix - 1) END AS account, round(l_extendedprice)::BIGINT AS pre, (l_quantity * 100)::BIGINT AS post, (l_quantity * 100)::BIGINT - round(l_extendedprice)::BIGINT AS delta FROM {IX} WHERE ix <= 5")
def balance_delta_zip(spark, d):
    from ..functions.transactions import balance_deltas

    one = F.struct("ix", _text("S", "l_suppkey").alias("a"), F.round("l_extendedprice").cast("decimal(20,0)").alias("x"), (F.col("l_quantity") * 100).cast("decimal(20,0)").alias("y"))
    g = ix_rows(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("r"))
    part = lambda f, n: F.slice(F.transform("r", lambda x: x[f]), 1, n)
    rows = g.select(F.col("l_orderkey").alias("slot"), F.posexplode(balance_deltas(part("a", 3), part("x", 1000), part("y", 5))).alias("idx", "b"))
    return rows.select("slot", F.col("idx").cast("long"), "b.account", F.col("b.pre_amount").cast("long").alias("pre"), F.col("b.post_amount").cast("long").alias("post"), "b.delta")


@register(f"SELECT a.l_orderkey AS slot, a.ix, coalesce(k.program, 'UNKNOWN_PROGRAM_INDEX_' || a.l_linenumber) AS program FROM {IX} a LEFT JOIN {IX} k ON k.l_orderkey = a.l_orderkey AND k.ix = a.l_linenumber + 1 AND k.ix <= 4")
def index_lookup(spark, d):
    g = ix_rows(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ix", "program", "l_linenumber"))).alias("r"))
    g = g.withColumn("keys", F.slice(F.transform("r", lambda x: x["program"]), 1, 4))
    return g.select(F.col("l_orderkey").alias("slot"), "keys", F.explode("r").alias("x")).select("slot", "x.ix", instructions.lookup("keys", F.col("x.l_linenumber").cast("int")).alias("program"))


@register("SELECT event_id, event_type AS name FROM events WHERE event_type IN ('click', 'purchase', 'view')")
def disc_dispatch(spark, d):
    layouts = spark.createDataFrame([("click",), ("purchase",), ("view",)], "name string").withColumn("mark", F.unhex(F.substring(F.sha2(F.concat(F.lit("event:"), "name"), 256), 1, 16)))
    coded = table(spark, d, "events").select("event_id", F.concat(F.unhex(F.substring(F.sha2(F.concat(F.lit("event:"), "event_type"), 256), 1, 16)), F.lit(b"payload")).alias("data"))
    return coded.withColumn("mark", F.substring("data", 1, 8)).join(F.broadcast(layouts), "mark").select("event_id", "name")


@register("SELECT o_orderkey AS slot FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 11)")
def target_semi_join(spark, d):
    targets = table(spark, d, "customer").where("c_acctbal < 0").select(_text("C", "c_custkey").alias("account")).unionAll(spark.sql("SELECT 'S11' AS account"))
    return instructions.in_targets(transactions(spark, d), targets, key="slot").select("slot")


@register("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1)")
def anti_done(spark, d):
    done = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(done, "o_orderkey", "left_anti")


@register(f"""WITH c AS (SELECT l_orderkey, ix, 'S' || l_suppkey AS account, CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice ELSE -l_extendedprice END AS delta FROM {IX})
SELECT a.l_orderkey AS tx_id, CASE WHEN b.ix = 1 THEN 'MASTER_DONOR' ELSE 'SIDE_DONOR' END AS role, b.account AS donor, a.account AS receiver, a.delta AS amount FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.ix <> b.ix WHERE a.delta > 0 AND b.delta < -a.delta""")
def counterparty_theta(spark, d):
    sign = F.when(F.col("l_linenumber") % 2 == 1, F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice"))
    changes = ix_rows(spark, d).select(F.col("l_orderkey").alias("tx_id"), F.col("ix").alias("idx"), _text("S", "l_suppkey").alias("account"), sign.alias("delta"))
    return balances.counterparties(changes)


@register("SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice - l_quantity * 1000 AS delta FROM lineitem WHERE abs(l_extendedprice - l_quantity * 1000) > 20000 AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def balance_threshold(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_extendedprice") - F.col("l_quantity") * 1000).alias("delta"))
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return rows.where(balances.over_threshold("delta", 20000)).join(rich, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey", "delta")


# ---------------------------------------------------------------- aggregates, windows


@register("SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS matched, count(*) FILTER (n > 0) AS with_records, coalesce(sum(n), 0)::BIGINT AS records, count(*) FILTER (o_orderkey % 97 = 0) AS decode_errors, count(*) FILTER (o_orderkey % 89 = 0) AS metadata_errors, count(*) FILTER (o_orderstatus = 'P') AS metadata_skipped FROM (SELECT *, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)")
def stats_counters(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").join(n, "o_orderkey", "left")
    flags = o.select((F.col("o_orderstatus") != "P").alias("matched"), F.coalesce("n", F.lit(0)).alias("records"), (F.col("o_orderkey") % 97 == 0).alias("decode_error"), (F.col("o_orderkey") % 89 == 0).alias("metadata_error"), (F.col("o_orderstatus") == "P").alias("metadata_skipped"))
    return reports.counters(flags)


_NODES = "(SELECT 'f' || (o_custkey % 3) AS file, o_orderkey AS pos, (CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE o_orderkey % 2 END)::BIGINT AS kind, o_orderkey + o_custkey AS slot, CASE WHEN o_orderkey % 10 = 0 THEN epoch(o_orderdate)::BIGINT END AS block_time FROM orders)"


def _nodes(spark, d):
    o = table(spark, d, "orders")
    k, ten = F.col("o_orderkey"), F.col("o_orderkey") % 10 == 0
    return o.select(F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("file"), k.alias("pos"), F.when(ten, 2).otherwise(k % 2).cast("long").alias("kind"), (k + F.col("o_custkey")).alias("slot"), F.when(ten, F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("block_time"))


@register(f"SELECT file, kind, count(*) AS nodes, arg_min(slot, pos) AS first_slot, arg_max(slot, pos) AS last_slot FROM {_NODES} GROUP BY file, kind")
def inspect_kind_counts(spark, d):
    return archive.inspect(_nodes(spark, d))


@register(f"SELECT file, arg_min(slot, pos) AS first_slot, arg_max(slot, pos) AS last_slot FROM {_NODES} WHERE kind = 2 GROUP BY file")
def inspect_slot_range(spark, d):
    return archive.inspect(_nodes(spark, d).where("kind = 2")).select("file", "first_slot", "last_slot")


_GROUPED = f"(SELECT *, coalesce(sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS group_id FROM {_NODES})"


@register(f"SELECT file, pos, group_id FROM {_GROUPED}")
def block_group_window(spark, d):
    return archive.block_groups(_nodes(spark, d)).select("file", "pos", "group_id")


@register(f"SELECT file, pos, max(CASE WHEN kind = 2 THEN block_time END) OVER (PARTITION BY file, group_id) AS block_time FROM {_GROUPED}")
def block_time_assign(spark, d):
    return archive.block_groups(_nodes(spark, d)).select("file", "pos", F.col("group_time").alias("block_time"))


@register("WITH c AS (SELECT event_type, count(*) AS n, count(*) FILTER (value < 10) AS n_errors FROM events GROUP BY event_type) SELECT event_type, n, n_errors, round(100.0 * n / (SELECT sum(n) FROM c), 4)::DOUBLE AS pct, round(100.0 * n_errors / n, 4)::DOUBLE AS error_pct FROM c ORDER BY n DESC, event_type LIMIT 3")
def decode_report_topk(spark, d):
    return reports.top_names(table(spark, d, "events").select("event_type", (F.col("value") < 10).alias("bad")), "event_type", 3, "bad")


@register("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def creator_last(spark, d):
    return reports.last_per_key(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey").drop("o_orderdate")


@register("SELECT round(quantile_cont(value::DOUBLE, 0.99), 6) AS p99 FROM events WHERE event_type = 'purchase'")
def percentile_filtered(spark, d):
    return reports.percentile(table(spark, d, "events").where("event_type = 'purchase'"), "value", 0.99, "p").select(F.round("p", 6).alias("p99"))


@register("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_trades, round(sum(value), 4) AS volume, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 1")
def daily_last(spark, d):
    by_day = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n_trades"), F.round(F.sum("value"), 4).alias("volume"), F.countDistinct("user_id").alias("n_users"))
    return by_day.orderBy(F.desc("day")).limit(1)


@register("SELECT c_custkey AS id, c_name AS label, c_acctbal AS balance FROM customer")
def rename_cols(spark, d):
    return reports.rename_present(table(spark, d, "customer"), {"c_custkey": "id", "c_name": "label", "c_acctbal": "balance", "c_absent": "absent"})


@register("SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def bool_filter(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") < 0).alias("flag")).where("flag").select("c_custkey")


@register("WITH s AS (SELECT DISTINCT o_custkey AS slot, o_custkey // 500 AS epoch FROM orders), g AS (SELECT epoch, slot - coalesce(lag(slot) OVER (PARTITION BY epoch ORDER BY slot) + 1, slot - slot % 500) AS gap FROM s) SELECT epoch, count(*) AS blocks, sum(gap)::BIGINT AS skipped FROM g GROUP BY epoch")
def skipped_slots(spark, d):
    return reports.skipped_slots(table(spark, d, "orders"), "o_custkey", 500)


@register("SELECT count(*) AS samples, round(avg(value), 6) AS mean FROM events WHERE event_id % 256 = 0")
def timing_sample(spark, d):
    return reports.sampled_mean(table(spark, d, "events"), "event_id", "value")


@register("SELECT n::BIGINT AS epoch, 'epoch-' || n || '.car' AS file FROM range(3, 13) t(n)")
def epoch_range(spark, d):
    low, *_, high = epochs("3..12")
    return spark.range(low, high + 1).select(F.col("id").alias("epoch"), F.concat(F.lit("epoch-"), F.col("id").cast("string"), F.lit(".car")).alias("file"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE o_orderkey END AS epoch FROM orders")
def epoch_from_filename(spark, d):
    k = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("/data/epoch-"), k, F.lit(".parquet"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("epoch_"), k, F.lit(".jsonl"))).otherwise(F.concat(F.lit("part-"), k, F.lit(".csv")))
    return table(spark, d, "orders").select("o_orderkey", epoch_of(name).alias("epoch"))


@register("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedupe_cid(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@register("SELECT o_orderkey, format('{:,}', round(o_totalprice)::BIGINT) AS amount, printf('%02d:%02d:%02d', o_orderkey // 3600, o_orderkey % 3600 // 60, o_orderkey % 60) AS clock FROM orders")
def number_formats(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice").cast("long").alias("v"))
    return o.select("o_orderkey", reports.thousands("v").alias("amount"), reports.clock("o_orderkey").alias("clock"))


@register("SELECT substr(sha256('event:' || event_type), 1, 16) AS mark, count(*) AS n FROM events GROUP BY 1")
def discriminator(spark, d):
    return table(spark, d, "events").groupBy(F.substring(F.sha2(F.concat(F.lit("event:"), "event_type"), 256), 1, 16).alias("mark")).agg(F.count("*").alias("n"))


@register("SELECT event_id, (props->>'k')::BIGINT AS k, NULL::VARCHAR AS absent FROM events")
def json_coerce(spark, d):
    from ..functions.borsh import typed

    return table(spark, d, "events").select("event_id", typed(F.col("props"), "k long, absent string").alias("p")).select("event_id", "p.k", "p.absent")


@register("""SELECT '{' || string_agg('"' || n_nationkey || '":{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}', ',' ORDER BY n_nationkey::VARCHAR) || '}' AS json FROM nation""")
def json_index_export(spark, d):
    return reports.to_index(table(spark, d, "nation"), "n_nationkey")
