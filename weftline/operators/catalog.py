"""Catalog analytics: heuristics, run matching, usage, decommissioning and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers by what a name starts with, in order; RAW also by what it contains.
RAW_PARTS = ("RAW_", "STAGE_", "STG_RAW")
LAYERS = (
    ("STAGING", ("STG_", "STAGE_")),
    ("INTEGRATION", ("DIM_", "FACT_", "F_", "D_", "BRIDGE_", "INT_")),
    ("REPORTING", ("RPT_", "MART_", "AGG_", "DSH_")),
    ("REPORTING", ("VW_", "V_")),
)
#: Business names that are raw tables.
RAW_NAMES = ("MEMBERS", "ACCOUNTS", "ACCOUNT_TYPES", "ACCOUNT_INVESTMENTS", "INVESTMENT_OPTIONS", "TRANSACTIONS", "ETL_EXECUTION_LOGS", "MEMBER_ADDRESSES", "MONTHLY_FEE_SUMMARIES", "TRANSACTION_STATS", "CORE_TAX_LIABILITY", "STG_DAILY_METRICS")
#: The first part that a name contains gives its domain.
DOMAINS = (
    ("MEMBER", "MEMBER"), ("CLIENT", "MEMBER"), ("CUSTOMER", "MEMBER"), ("INVESTOR", "MEMBER"), ("ACCOUNT", "ACCOUNT"),
    ("HOLDING", "HOLDING"), ("FUND", "HOLDING"), ("PORTFOLIO", "HOLDING"), ("INVESTMENT", "INVESTMENT"), ("TRANSACTION", "TRANSACTION"),
    ("TXN", "TRANSACTION"), ("FEE", "FEE"), ("PENSION", "TRANSACTION"), ("CONTRIB", "TRANSACTION"), ("TAX", "TRANSACTION"),
    ("ADVISER", "ADVISER"), ("ADVISOR", "ADVISER"), ("PRODUCT", "PRODUCT"), ("ETL", "AUDIT"), ("AUDIT", "AUDIT"),
    ("LOG", "AUDIT"), ("BALANCE", "ACCOUNT"), ("DAILY", "TRANSACTION"), ("REF_", "REFERENCE"),
)
#: Tags of target names by prefix, then by suffix.
TAG_PREFIXES = (("staging", ("stg_", "stage_", "raw_", "src_")), ("core", ("core_", "int_", "intermediate_")), ("reporting", ("fact_", "dim_", "mart_", "agg_")), ("delivery", ("final_", "dlv_", "delivery_")))
TAG_SUFFIXES = (("reporting", ("_summary", "_report", "_reporting", "_dashboard", "_kpi")), ("delivery", ("_extract", "_export", "_feed")), ("staging", ("_stg", "_staging")))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def layer(name: Column) -> Column:
    """Layer of a table name; without a rule, UNKNOWN."""
    n = F.upper(name)
    out = F.when(_any([n.contains(p) for p in RAW_PARTS]), "RAW")
    for value, starts in LAYERS:
        out = out.when(_any([n.startswith(s) for s in starts]), value)
    return out.when(n.isin(*RAW_NAMES), "RAW").otherwise("UNKNOWN")


def domain(name: Column) -> Column:
    n, out = F.upper(name), None
    for part, value in DOMAINS:
        out = F.when(n.contains(part), value) if out is None else out.when(n.contains(part), value)
    return out.otherwise("OTHER")


def tag(name: Column) -> Column:
    n, out = F.lower(name), F.when(F.lit(False), "")
    for value, starts in TAG_PREFIXES:
        out = out.when(_any([n.startswith(s) for s in starts]), value)
    for value, ends in TAG_SUFFIXES:
        out = out.when(_any([n.endswith(s) for s in ends]), value)
    return out.otherwise("transformation")


def canonical(name: Column) -> Column:
    """Lower case without a leading number, as ``01_x`` and ``x`` are one pipeline."""
    return F.regexp_replace(F.lower(name), "^[0-9]+_", "")


def run_stats(runs: DataFrame) -> DataFrame:
    """Per pipeline of a run log: totals, successes, failures, first and last run."""
    ok = F.upper("status").isin("SUCCESS", "COMPLETED", "OK")
    return runs.groupBy("pipeline_name").agg(
        F.max("csv_generated").alias("csv_generated"), F.count(F.lit(1)).alias("runs_total"), F.sum(F.when(ok, 1).otherwise(0)).alias("runs_success"),
        F.sum(F.when(ok, 0).otherwise(1)).alias("runs_failed"), F.min("start_time").alias("first_run"), F.max("start_time").alias("last_run"),
    )


def matched_runs(pipelines: DataFrame, stats: DataFrame) -> DataFrame:
    """Pipelines with the summed stats of all log names of theirs; runs without a pipeline follow with has_definition false."""
    by = stats.groupBy(canonical(F.col("pipeline_name")).alias("_c")).agg(
        F.min("pipeline_name").alias("_name"), F.max("csv_generated").alias("_csv"), F.sum("runs_total").alias("runs_total"), F.sum("runs_success").alias("runs_success"),
        F.sum("runs_failed").alias("runs_failed"), F.min("first_run").alias("first_run"), F.max("last_run").alias("last_run"),
    )
    own = pipelines.withColumn("_c", canonical(F.col("name")))
    totals = ["runs_total", "runs_success", "runs_failed"]
    counted = [F.coalesce(c, F.lit(0)).alias(c) for c in totals]
    known = own.join(by, "_c", "left").select(F.col("name").alias("pipeline_name"), "output_csv", F.coalesce("csv_exists", F.lit(False)).alias("csv_exists"), *counted, "first_run", "last_run", F.lit(True).alias("has_definition"))
    orphans = by.join(own, "_c", "left_anti").select(F.col("_name").alias("pipeline_name"), F.col("_csv").alias("output_csv"), F.lit(False).alias("csv_exists"), *totals, "first_run", "last_run", F.lit(False).alias("has_definition"))
    return known.unionByName(orphans)


def pipeline_usage(matched: DataFrame) -> DataFrame:
    """Success rate, status and whether a pipeline ran outside the log."""
    off = F.col("has_definition") & F.col("csv_exists") & (F.col("runs_total") == 0)
    status = F.when(~F.col("has_definition"), "undocumented").when(off, "off-grid").when(F.col("runs_total") == 0, "never-run").when(F.col("runs_failed") > 0, "failing").otherwise("healthy")
    return matched.withColumn("success_rate", F.coalesce(F.try_divide(F.lit(100.0) * F.col("runs_success"), F.col("runs_total")), F.lit(0.0))).withColumn("ran_without_logging", off).withColumn("status", status)


#: Titles of findings.
NO_KEY, UNDEFINED, UNLOGGED, NEVER, FAILING = "Table has no primary key", "Pipeline running without source definition", "Pipeline ran without logging", "Pipeline never executed", "Pipeline failure rate "


def flags(tables: DataFrame, columns: DataFrame, matched: DataFrame) -> DataFrame:
    """severity, title and object of catalog findings."""
    keyed = columns.filter("is_pk").select(F.col("table_fqn").alias("fqn")).distinct()
    no_pk = tables.filter("kind = 'TABLE'").join(keyed, "fqn", "left_anti").select(F.lit("warn").alias("severity"), F.lit(NO_KEY).alias("title"), F.col("fqn").alias("object"))
    share = F.try_divide(F.lit(100.0) * F.col("runs_failed"), F.col("runs_total"))
    known, silent = F.col("has_definition"), F.col("runs_total") == 0
    title = (
        F.when(~known, UNDEFINED).when(silent & F.col("csv_exists"), UNLOGGED)
        .when(silent, NEVER).when(share >= 5, F.concat(F.lit(FAILING), F.format_string("%.1f", share), F.lit("%")))
    )
    grave = F.when(~known | (silent & F.col("csv_exists")) | (~silent & (share >= 10)), "critical").otherwise("warn")
    return no_pk.unionByName(matched.select(grave.alias("severity"), title.alias("title"), F.col("pipeline_name").alias("object")).filter("title IS NOT NULL"))


def output_check(pipelines: DataFrame, files: DataFrame) -> DataFrame:
    """Pipelines with whether a file of their output's base name exists."""
    base = lambda c: F.lower(F.element_at(F.split(c, "/"), -1))
    have = files.select(base("path").alias("_b")).distinct().withColumn("_hit", F.lit(True))
    return pipelines.withColumn("_b", base("output_csv")).join(have, "_b", "left").withColumn("csv_exists", F.coalesce("_hit", F.lit(False))).drop("_b", "_hit")


def read_pressure(pipelines: DataFrame, matched: DataFrame) -> DataFrame:
    """Reads of each source: the runs of the pipelines that use it, one for a pipeline that the log doesn't know."""
    runs = matched.filter("has_definition").select(F.col("pipeline_name").alias("name"), F.col("runs_total").alias("_runs"), F.col("last_run").alias("_last"))
    used = pipelines.select("name", F.explode("source_tables").alias("_t")).join(runs, "name", "left")
    fqn = F.when(F.col("_t").contains("."), F.upper("_t")).otherwise(F.concat(F.lit("SOURCE."), F.upper("_t")))
    n = F.when(F.col("_last").isNull() & (F.coalesce("_runs", F.lit(0)) == 0), 1).otherwise(F.col("_runs"))
    return used.groupBy(fqn.alias("fqn")).agg(F.sum(n).alias("read_count"))


def awr_usage(awr: DataFrame) -> DataFrame:
    """Reads, writes and distinct users of the ``SCHEMA.TABLE`` names in logged statements, weighted by executions."""
    names = F.regexp_extract_all(F.upper("sql_text"), F.lit(r"\b([A-Z][A-Z0-9_]+)\.([A-Z][A-Z0-9_]+)\b"), F.lit(0))
    write = F.col("sql_text").rlike(r"(?i)\b(INSERT|UPDATE|MERGE|DELETE)\b")
    rows = awr.select(F.explode(names).alias("fqn"), write.alias("_w"), F.coalesce("executions", F.lit(1)).alias("_n"), "user", "last_active")
    pick = lambda cond, c: F.when(cond, F.col(c))
    return rows.groupBy("fqn").agg(
        F.sum(F.when(~F.col("_w"), F.col("_n")).otherwise(0)).alias("read_count"), F.sum(F.when(F.col("_w"), F.col("_n")).otherwise(0)).alias("write_count"),
        F.count_distinct("user").alias("distinct_users"), F.max(pick(~F.col("_w"), "last_active")).alias("last_read"), F.max(pick(F.col("_w"), "last_active")).alias("last_write"),
    )


def write_only(usage: DataFrame) -> DataFrame:
    return usage.filter("write_count > 0 AND read_count = 0").select("fqn")


def dead(tables: DataFrame, usage: DataFrame) -> DataFrame:
    """Tables that no usage names, neither by their own name nor as a source."""
    seen = usage.select(F.upper("fqn").alias("_f")).distinct()
    t = tables.filter("kind = 'TABLE'")
    return t.join(seen, F.upper("fqn") == F.col("_f"), "left_anti").join(seen, F.concat(F.lit("SOURCE."), F.upper("name")) == F.col("_f"), "left_anti").select("fqn")


def decommission(tables: DataFrame, readers: DataFrame, writers: DataFrame, consumers: DataFrame, fk_targets: DataFrame, as_of: str) -> DataFrame:
    """Scores and verdicts of tables.

    readers, writers and consumers have ``fqn`` and ``by``; fk_targets has
    ``fqn``. From 100: 30 less if written, 60 if read, 30 if views consume it,
    10 if a foreign key names it; 20 more if not analysed for seven years, 15 if
    its name is a legacy one; within 0 and 100. From 80 on it is safe, from 50
    to be reviewed, else blocked.
    """
    out = tables.filter("kind <> 'CSV'")
    for frame, name in ((readers, "n_readers"), (writers, "n_writers"), (consumers, "n_consumers")):
        out = out.join(frame.groupBy("fqn").agg(F.count_distinct("by").alias(name)), "fqn", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    out = out.join(fk_targets.select("fqn").distinct().withColumn("is_fk_target", F.lit(True)), "fqn", "left").withColumn("is_fk_target", F.coalesce("is_fk_target", F.lit(False)))
    days = F.greatest(F.lit(0), F.datediff(F.expr(as_of), F.col("last_analyzed")))
    old = F.coalesce(days > 365 * 7, F.lit(False))
    legacy = F.upper("schema_name").startswith("WH_LEGACY") | F.upper("name").contains("LEGACY")
    less = lambda cond, n: F.when(cond, n).otherwise(0)
    raw = F.lit(100) - less(F.col("n_writers") > 0, 30) - less(F.col("n_readers") > 0, 60) - less(F.col("n_consumers") > 0, 30) - less(F.col("is_fk_target"), 10) + less(old, 20) + less(legacy, 15)
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    return out.select("fqn", score.alias("score"), F.when(score >= 80, "safe").when(score >= 50, "review").otherwise("blocked").alias("verdict"), days.alias("days_since"), old.alias("archive_eligible"), "n_readers", "n_writers", "n_consumers", "is_fk_target")


#: Words of writers that end rows' lives, and of writers that divide a target by origin.
LIFECYCLE, ORIGINS = ("expire", "delete", "archive", "purge", "retire"), ("mel", "syd", "per", "src1", "src2", "src3", "raw", "stage")


def multi_writers(pipelines: DataFrame) -> DataFrame:
    """Targets with several writers, and the pattern that their names suggest."""
    by = pipelines.filter("output_csv IS NOT NULL").groupBy(F.col("output_csv").alias("target")).agg(F.sort_array(F.collect_set("name")).alias("writers")).filter("size(writers) >= 2")
    text = F.lower(F.array_join("writers", " "))
    parts = F.filter(F.split(F.regexp_replace(text, "_", " "), " "), lambda t: t.isin(*ORIGINS))
    pattern = F.when(text.rlike("|".join(LIFECYCLE)), "lifecycle").when(F.size(F.array_distinct(parts)) >= 2, "disjoint").when(F.size("writers") <= 3, "update_back").otherwise("unknown")
    return by.withColumn("pattern", pattern)


def scope(pipelines: DataFrame, tables: DataFrame) -> DataFrame:
    """kind, name, in_scope and reason: pipelines that ran, tables that aren't safe to drop."""
    ran = (F.col("runs_total") > 0) | F.col("csv_exists")
    p = pipelines.filter("has_definition").select(F.lit("pipeline").alias("kind"), F.col("pipeline_name").alias("name"), ran.alias("in_scope"), F.when(~ran, "no execution history and no output").alias("reason"))
    safe = F.coalesce(F.col("verdict") == "safe", F.lit(False))
    t = tables.select(F.lit("table").alias("kind"), F.col("fqn").alias("name"), (~safe).alias("in_scope"), F.when(safe, "decommission verdict: safe").alias("reason"))
    return p.unionByName(t)


def manifest(scope_: DataFrame) -> DataFrame:
    """A scope as one row for each kind: counts, and the sorted names in and out of it. Lists have a name for each object of a catalog."""
    inside = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("name"))))
    return scope_.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_scope").alias("n_in_scope"), inside(F.col("in_scope")).alias("included"), inside(~F.col("in_scope")).alias("excluded"))


def confidence(files: DataFrame) -> DataFrame:
    """Confidence and band from counts of errors, warnings and parser warnings, and whether a star was projected."""
    raw = F.lit(100) - 25 * F.col("errors") - 10 * F.col("warnings") - 5 * F.col("parser_warnings") - F.when(F.col("has_star"), 10).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    return files.withColumn("confidence", score).withColumn("band", F.when(score >= 90, "high").when(score >= 70, "medium").otherwise("low"))


def undocumented(produced: DataFrame, documented: DataFrame) -> DataFrame:
    """Produced files, by lower base name, that no document names."""
    base = lambda: F.lower(F.element_at(F.split("csv_name", "/"), -1)).alias("csv_name")
    return produced.select(base()).distinct().join(documented.select(base()).distinct(), "csv_name", "left_anti")


def roi(n_pipelines: Column, n_procedures: Column, n_bytes: Column) -> list[Column]:
    """Days by hand and assisted, days and money saved, and monthly storage and query cost of real bytes."""
    manual, fast = n_pipelines * 7.0 + n_procedures * 5.0, n_pipelines * 0.5 + n_procedures * 1.0
    saved = F.greatest(F.lit(0.0), manual - fast)
    storage = n_bytes / 1e9 * 0.02
    query = n_bytes * F.greatest(F.lit(1), n_pipelines) * 30 / 1e12 * 5
    return [manual.alias("manual_days"), fast.alias("assisted_days"), saved.alias("days_saved"), (saved * 1800).alias("money_saved"), F.try_divide(manual, fast).alias("speedup"), storage.alias("storage_month"), query.alias("query_month"), ((storage + query) * 12).alias("total_year")]


def parity_preview(pipelines: DataFrame, tables: DataFrame) -> DataFrame:
    """Per pipeline: bytes and largest row count of its distinct sources."""
    used = pipelines.select("name", F.explode(F.array_distinct(F.transform("source_tables", lambda t: F.upper(F.element_at(F.split(t, r"\."), -1))))).alias("_t"))
    t = tables.select(F.upper("name").alias("_t"), "bytes", "row_count")
    return used.join(t, "_t", "left").groupBy("name").agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max("row_count").alias("max_rows"))


def search(tables: DataFrame, text: str = "", layer_: str | None = None) -> DataFrame:
    out = tables.filter(F.lower("fqn").contains(text.lower())) if text else tables
    return out.filter(F.col("layer") == layer_) if layer_ else out


def digest(tables: DataFrame, usage: DataFrame, flags_: DataFrame) -> DataFrame:
    """metric and value of the counts that a summary shows."""
    parts = [
        tables.groupBy(F.concat(F.lit("tables."), F.lower("layer")).alias("metric")).agg(F.count(F.lit(1)).alias("value")),
        usage.groupBy(F.concat(F.lit("pipelines."), "status").alias("metric")).agg(F.count(F.lit(1)).alias("value")),
        flags_.groupBy(F.concat(F.lit("flags."), "severity").alias("metric")).agg(F.count(F.lit(1)).alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Name patterns of sensitive columns, most severe first.
SENSITIVE = (("PII", r"(?i)(^|_)(name|surname|given_name|first_name|last_name|dob|birth|email|phone|mobile|address|postcode|passport|licen[cs]e)(_|$)"), ("TAX", r"(?i)(^|_)(tfn|tax|ssn)(_|$)"), ("FINANCIAL", r"(?i)(amount|amt|balance|price|salary|fee|acctbal|value)"), ("INTERNAL", r"(?i)(_id|_sk|key)$"))


def sensitivity(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for value, pattern in SENSITIVE:
        out = out.when(name.rlike(pattern), value)
    return out.otherwise("PUBLIC")
