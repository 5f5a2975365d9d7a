"""The library's queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import distributions as D
from weftline.functions import words
from weftline.functions.generators import Context, alias_table, generate, random_numbers, register_arrow
from weftline.functions.rng import number, stream, uniform
from weftline.operators import anonymize, quality
from weftline.operators.generate import Generator, generate_tables, growth, inverse_growth, preview, seasonal_weight
from weftline.operators.runs import clone, reset
from weftline.plans import drift, graph, sql
from weftline.plans.build import as_field, build_plan, preflight
from weftline.plans.model import Check, Column, Field, ForeignKey, Persona, Plan, Schema, Table, TablePlan, Timeline
from weftline.plans.registry import query, table
from weftline.plans.semantic import analyze, coverage
from weftline.sources import catalog, documents, stores
from weftline.streaming import sinks

SEED, REFERENCE = 42, 1_720_000_000_000
CONTEXT = Context(REFERENCE)
KEYS = {
    "region": {"primary_key": ["r_regionkey"]},
    "nation": {"primary_key": ["n_nationkey"], "foreign_keys": {"n_regionkey": ("region", "r_regionkey")}},
    "customer": {"primary_key": ["c_custkey"], "foreign_keys": {"c_nationkey": ("nation", "n_nationkey")}},
    "supplier": {"primary_key": ["s_suppkey"], "foreign_keys": {"s_nationkey": ("nation", "n_nationkey")}},
    "part": {"primary_key": ["p_partkey"]},
    "orders": {"primary_key": ["o_orderkey"], "foreign_keys": {"o_custkey": ("customer", "c_custkey")}},
    "lineitem": {"foreign_keys": {"l_orderkey": ("orders", "o_orderkey"), "l_partkey": ("part", "p_partkey"), "l_suppkey": ("supplier", "s_suppkey")}},
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in KEYS}


def cell(name: str, key: str, column: str):
    return stream(SEED, name, "__row__", F.col(key).cast("string"), column)


def cell_sql(name: str, key: str, column: str, n: int = 1, columns: str | None = None) -> str:
    return sql.draws(name, columns or key, ("'42'", f"'{name}'", "'__row__'", f"{key}::VARCHAR", f"'{column}'"), n)


# Random numbers and generators


@query("rng_streams", f"SELECT o_orderkey, s AS state, u1, u2 FROM {cell_sql('orders', 'o_orderkey', 'x', 2)}")
def rng_streams(spark, sf_dir):
    s = cell("orders", "o_orderkey", "x")
    return table(spark, sf_dir, "orders").select("o_orderkey", s.alias("state"), uniform(s).alias("u1"), uniform(s, 2).alias("u2"))


UUID_SQL = """SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || substr('89ab', floor(u5 * 4)::INT + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT *, lpad(lower(to_hex(x1)), 8, '0') || lpad(lower(to_hex(x2)), 8, '0') || lpad(lower(to_hex(x3)), 8, '0') || lpad(lower(to_hex(x4)), 8, '0') AS h FROM """ + cell_sql("customer", "c_custkey", "id", 5) + ")"


@query("gen_uuid", UUID_SQL)
def gen_uuid(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", generate("uuid", {}, cell("customer", "c_custkey", "id"), CONTEXT).alias("id"))


@query("gen_uniform", f"SELECT p_partkey, floor(u1 * 100)::BIGINT + 1 AS whole, round(u2 * 5 - 2, 6) AS real FROM {cell_sql('part', 'p_partkey', 'n', 2)}")
def gen_uniform(spark, sf_dir):
    s = cell("part", "p_partkey", "n")
    return table(spark, sf_dir, "part").select("p_partkey", D.uniform_int(s, 1, 100).alias("whole"), F.round(D.uniform_real(s, -2, 3, 2), 6).alias("real"))


@query("gen_weighted", f"SELECT c_custkey, CASE WHEN u1 < 0.5 THEN 'free' WHEN u1 < 0.5 + 0.3 THEN 'plus' ELSE 'pro' END AS plan FROM {cell_sql('customer', 'c_custkey', 'plan')}")
def gen_weighted(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", generate("weighted-categorical", {"values": {"free": 5, "plus": 3, "pro": 2}}, cell("customer", "c_custkey", "plan"), CONTEXT).alias("plan"))


@query("gen_continuous", f"SELECT o_orderkey, least(greatest(floor(1 * pow(1 - u1 * (1 - pow(1.0 / 100, 1.5)), -1 / 1.5) + 0.5), 1), 100)::BIGINT AS pareto, round(-ln(greatest(1 - u2, 1e-16)) / 0.5, 6) AS expo, round(sqrt(-2 * ln(greatest(u3, 1e-16))) * cos(2 * pi() * u4) * 2 + 10, 6) AS norm FROM {cell_sql('orders', 'o_orderkey', 'c', 4)}")
def gen_continuous(spark, sf_dir):
    s = cell("orders", "o_orderkey", "c")
    return table(spark, sf_dir, "orders").select("o_orderkey", D.pareto_int(s, 1, 100, 1.5).alias("pareto"), F.round(D.exponential(s, 0.5, 2), 6).alias("expo"), F.round(D.normal(s, 10, 2, 3), 6).alias("norm"))


ZIPF = [k**-1.2 for k in range(1, 21)]


@query("gen_zipf", f"SELECT o_orderkey, least(len(list_filter({[sum(ZIPF[: i + 1]) / sum(ZIPF) for i in range(20)]}, lambda x: x <= u1)) + 1, 20)::BIGINT AS rank FROM {cell_sql('orders', 'o_orderkey', 'z')}")
def gen_zipf(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", D.zipf(cell("orders", "o_orderkey", "z"), 20, 1.2).alias("rank"))


@query("gen_scalars", f"SELECT p_partkey, u1 < 0.8 AS flag, floor(exp(sqrt(-2 * ln(greatest(u1, 1e-16))) * cos(2 * pi() * u2) * 1.5 + 4) * 100 + 0.5) / 100 AS price, round(u1 * 180 - 90, 6) AS lat FROM {cell_sql('part', 'p_partkey', 's', 2)}")
def gen_scalars(spark, sf_dir):
    s = cell("part", "p_partkey", "s")
    kinds = {"flag": ("boolean-skewed", {"skew": 0.8}), "price": ("log-normal-currency", {}), "lat": ("lat-lng-pair", {"axis": "lat"})}
    cells = {n: generate(k, p, s, CONTEXT) for n, (k, p) in kinds.items()}
    return table(spark, sf_dir, "part").select("p_partkey", cells["flag"].alias("flag"), cells["price"].alias("price"), F.round(cells["lat"], 6).alias("lat"))


@query("gen_timestamps", f"SELECT o_orderkey, floor({REFERENCE}.0 - u1 * u2 * (30 * 86400000.0))::BIGINT AS recent_ms, floor(epoch_ms(o_orderdate) + u1 * 604800000.0)::BIGINT AS later_ms FROM {cell_sql('orders', 'o_orderkey', 't', 2, 'o_orderkey, o_orderdate')}")
def gen_timestamps(spark, sf_dir):
    s = cell("orders", "o_orderkey", "t")
    context = Context(REFERENCE, {"created_at": F.col("o_orderdate")})
    later = generate("dependent-timestamp", {"dependsOn": "created_at"}, s, context)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_millis(generate("recent-timestamp", {"withinDays": 30}, s, context)).alias("recent_ms"), F.unix_millis(later).alias("later_ms"))


@query("gen_slug", r"SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def gen_slug(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", generate("derived-slug", {"sourceColumn": "name"}, F.lit(0), Context(0, {"name": F.col("p_name")})).alias("slug"))


@query("gen_words", f"SELECT c_custkey, {words.FIRST}[floor(u1 * {len(words.FIRST)})::INT + 1] || ' ' || {words.LAST}[floor(u2 * {len(words.LAST)})::INT + 1] AS name FROM {cell_sql('customer', 'c_custkey', 'w', 2)}")
def gen_words(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", generate("fullName", {}, cell("customer", "c_custkey", "w"), CONTEXT).alias("name"))


@query("gen_fk_pick", f"SELECT c.c_custkey, n.n_nationkey, n.n_name FROM (SELECT c_custkey, floor(u1 * (SELECT count(*) FROM nation))::BIGINT AS at FROM {cell_sql('customer', 'c_custkey', 'nation')}) c JOIN (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS at FROM nation) n ON c.at = n.at")
def gen_fk_pick(spark, sf_dir):
    """A reference to rows of an existing table, by their number: a join on the number."""
    nation = table(spark, sf_dir, "nation")
    numbered = nation.withColumn("at", F.row_number().over(Window.orderBy("n_nationkey")) - 1)  # 25 rows at any scale
    at = F.floor(uniform(cell("customer", "c_custkey", "nation")) * float(nation.count()))
    return table(spark, sf_dir, "customer").select("c_custkey", at.alias("at")).join(numbered, "at").select("c_custkey", "n_nationkey", "n_name")


def one_of_sql(values: list[str], u: str) -> str:
    return f"{values}[floor({u} * {len(values)})::INT + 1]"


@query("gen_contacts", f"SELECT c_custkey, '+1-555-' || lpad(floor(u1 * 1000)::INT::VARCHAR, 3, '0') || '-' || lpad(floor(u2 * 10000)::INT::VARCHAR, 4, '0') AS phone, lpad(floor(u1 * 100000)::INT::VARCHAR, 5, '0') AS zip, (floor(u1 * 999)::INT + 1) || ' ' || {one_of_sql(words.STREETS, 'u2')} || ' Street' AS street, (floor(u1 * 254)::INT + 1) || '.' || floor(u2 * 255)::INT || '.' || floor(u3 * 255)::INT || '.' || floor(u4 * 255)::INT AS ip, 'https://' || {one_of_sql(words.DOMAINS, 'u1')} || '/' || {one_of_sql(words.WORDS, 'u2')} AS url FROM {cell_sql('customer', 'c_custkey', 'contact', 4)}")
def gen_contacts(spark, sf_dir):
    s = cell("customer", "c_custkey", "contact")
    return table(spark, sf_dir, "customer").select("c_custkey", *[generate(k, {}, s, CONTEXT).alias(k) for k in ("phone", "zip", "street", "ip", "url")])


LETTER = "substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', floor(u{k} * 36)::INT + 1, 1)"
WORDY = " || ' ' || ".join(one_of_sql(words.WORDS, f"u{k}") for k in range(2, 6))
TITLE = lambda w: f"upper(substr({w}, 1, 1)) || substr({w}, 2)"


@query("gen_texts", f"SELECT p_partkey, {' || '.join(LETTER.format(k=k) for k in range(1, 5))} AS sku, lower({one_of_sql(words.FIRST, 'u1')}) || '.' || lower({one_of_sql(words.LAST, 'u2')}) || lpad(lower(to_hex(x3)), 8, '0') || '@' || {one_of_sql(words.DOMAINS, 'u4')} AS email, {TITLE(one_of_sql(words.WORDS, 'u1'))} || ' ' || {WORDY} || '.' AS longText, {TITLE(one_of_sql(words.WORDS, 'u1'))} || ' ' || {TITLE(one_of_sql(words.WORDS, 'u2'))} AS word, {one_of_sql([c[0] for c in words.CITIES], 'u1')} AS city, {one_of_sql(words.STATES, 'u1')} AS state FROM {cell_sql('part', 'p_partkey', 'text', 5)}")
def gen_texts(spark, sf_dir):
    s = cell("part", "p_partkey", "text")
    kinds = {"sku": {"length": 4}, "email": {}, "longText": {"count": 5}, "word": {}, "city": {}, "state": {}}
    return table(spark, sf_dir, "part").select("p_partkey", *[generate(k, p, s, CONTEXT).alias(k) for k, p in kinds.items()])


#: Places with weights, in fixed order: what a record's columns are drawn from together.
PLACES = [{"city": "Aster", "country": "North", "lat": 61.5, "people": 5}, {"city": "Birch", "country": "North", "lat": 58.25, "people": 1}, {"city": "Clove", "country": "South", "lat": -12.75, "people": 3}]
SHARE, OTHER = alias_table([p["people"] for p in PLACES])
AT_SQL = f"CASE WHEN u2 < {SHARE}[floor(u1 * 3)::INT + 1] THEN floor(u1 * 3)::INT + 1 ELSE {OTHER}[floor(u1 * 3)::INT + 1] + 1 END"


@query("correlated_places", f"SELECT i + 1 AS id, {[p['city'] for p in PLACES]}[nth] AS city, {[p['country'] for p in PLACES]}[nth] AS country, {[p['lat'] for p in PLACES]}[nth]::DOUBLE AS lat FROM (SELECT i, {AT_SQL} AS nth FROM {sql.draws('(SELECT c_custkey AS i FROM customer)', 'i', (chr(39) + '42' + chr(39), chr(39) + 'person' + chr(39), chr(39) + '__row__' + chr(39), 'i::VARCHAR', chr(39) + '__record__' + chr(39), chr(39) + 'home' + chr(39)), 2)})")
def correlated_places(spark, sf_dir):
    """City, country and latitude of as many rows as there are customers: one draw for the three, by weight."""
    of = lambda f: Field("record", {"of": "choice", "rows": PLACES, "weight": "people", "group": "home", "field": f})
    schema = Schema.of(Table("person", (Column("id", "integer", primary=True), Column("city"), Column("country"), Column("lat", "float")), ("id",)))
    plan = TablePlan("person", table(spark, sf_dir, "customer").count(), {"id": Field("row-number")} | {c: of(c) for c in ("city", "country", "lat")})
    return generate_tables(spark, Plan(schema, {"person": plan}, SEED))["person"].withColumn("id", F.col("id").cast("long"))


# Rows


@query("persona_counts", "SELECT CASE WHEN u1 < 0.15 THEN 'heavy' WHEN u1 < 0.15 + 0.25 THEN 'casual' ELSE 'lurker' END AS persona, count(*) AS n FROM " + sql.draws("customer", "c_custkey", ("'42'", "'customer'", "'__persona__'", "c_custkey::VARCHAR")) + " GROUP BY ALL")
def persona_counts(spark, sf_dir):
    s = stream(SEED, "customer", "__persona__", F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select(D.weighted(s, {"heavy": 0.15, "casual": 0.25, "lurker": 0.6}).alias("persona")).groupBy("persona").agg(F.count("*").alias("n"))


@query("fanout_children", "SELECT parent, before + k AS child, k AS nth FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, sum(n) OVER (ORDER BY parent) - n AS before FROM (SELECT c_custkey AS parent, floor(u1 * 4)::BIGINT AS n FROM " + sql.draws("customer", "c_custkey", ("'42'", "'orders'", "'__parent__'", "'customer'", "c_custkey::VARCHAR")) + ")))")
def fanout_children(spark, sf_dir):
    row = F.col("c_custkey")
    counts = table(spark, sf_dir, "customer").select(row.alias("__parent0"), D.count_of({"kind": "uniformInt", "min": 0, "max": 3}, stream(SEED, "orders", "__parent__", "customer", row.cast("string"))).alias("__n"))
    out = Generator.numbered(None, counts)
    return out.select(F.col("__parent0").alias("parent"), F.col("__row").alias("child"), F.col("__k").alias("nth"))


MONTHS = (1735689600000 - 1704067200000) / (86_400_000 * 30.436875)


@query("timeline_growth", f"SELECT o_orderkey, round(q, 6) AS linear, round(ln(1 + q * (exp(ln(1.15) * {MONTHS!r}) - 1)) / (ln(1.15) * {MONTHS!r}), 6) AS compound, round(least(greatest(0.5 - ln(1 / (lo + q * (hi - lo)) - 1) / 6.0, 0), 1), 6) AS scurve FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) / ((SELECT count(*) FROM orders) - 1)::DOUBLE AS q, 1 / (1 + exp(3.0)) AS lo, 1 / (1 + exp(-3.0)) AS hi FROM orders)")
def timeline_growth(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    n = orders.count()
    line = lambda kind, rate: Timeline(1704067200000, 1735689600000, kind, rate)
    q = F.col("o_orderkey") / float(n - 1)  # order keys are dense from 0
    return orders.select("o_orderkey", F.round(inverse_growth(line("linear", 0), q), 6).alias("linear"), F.round(inverse_growth(line("compound", 0.15), q), 6).alias("compound"), F.round(inverse_growth(line("scurve", 0.6), q), 6).alias("scurve"))


@query("timeline_models", "SELECT o_orderkey, round((sqrt(1 + 8 * q) - 1) / 2, 6) AS tripled, round(least(greatest(0.3 - ln(1 / (lo + q * (hi - lo)) - 1) / 8.0, 0), 1), 6) AS early, round((2 * q + 2 * q * q) / 4, 6) AS grown FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) / ((SELECT count(*) FROM orders) - 1)::DOUBLE AS q, 1 / (1 + exp(8 * 0.3::DOUBLE)) AS lo, 1 / (1 + exp(8 * -0.7::DOUBLE)) AS hi FROM orders)")
def timeline_models(spark, sf_dir):
    """Linear growth to three times the start, an early scurve, and how far the first has come at a share of the time."""
    orders = table(spark, sf_dir, "orders")
    line = lambda kind, **more: Timeline(1704067200000, 1735689600000, kind, **more)
    q = F.col("o_orderkey") / float(orders.count() - 1)  # order keys are dense from 0
    return orders.select("o_orderkey", F.round(inverse_growth(line("linear", total_growth=3), q), 6).alias("tripled"), F.round(inverse_growth(line("scurve", steepness=8, inflection=0.3), q), 6).alias("early"), F.round(growth(line("linear", total_growth=3), q), 6).alias("grown"))


@query("infer_nested", "SELECT count(DISTINCT l_partkey) AS n_distinct, count(DISTINCT p_partkey) AS n_found, count(DISTINCT p_partkey) / count(DISTINCT l_partkey)::DOUBLE AS ratio FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def infer_nested(spark, sf_dir):
    """Inclusion of a reference that lies in objects of an array: the parts of orders that hold their items."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.struct(F.col("l_partkey").alias("key")).alias("part"))).alias("items"))
    return graph.inclusion(orders, "items[].part.key", table(spark, sf_dir, "part"), "p_partkey")


@query("seasonal_revenue", "SELECT month(o_orderdate)::INT AS month, count(*) AS n, round(sum(CASE month(o_orderdate) WHEN 1 THEN 0.7 WHEN 2 THEN 0.85 WHEN 10 THEN 0.8 WHEN 11 THEN 1.8 WHEN 12 THEN 2.0 ELSE 1.0 END), 4) AS weight FROM orders GROUP BY 1")
def seasonal_revenue(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum(seasonal_weight(F.col("o_orderdate"))), 4).alias("weight"))


SEASONAL = (1704931200000, 1750550400000)  # from within a month to within another
SEASON_MONTHS = (SEASONAL[1] - SEASONAL[0]) / (86_400_000 * 30.436875)
GROWN = "(exp({t} * ln(1.05) * " + repr(SEASON_MONTHS) + ") - 1) / (exp(ln(1.05) * " + repr(SEASON_MONTHS) + ") - 1)"
SEASON_SQL = f"""
WITH m AS (SELECT s AS first, greatest(0, (epoch_ms(s) - {SEASONAL[0]}) / {float(SEASONAL[1] - SEASONAL[0])!r}) AS lo, least(1, (epoch_ms(s + INTERVAL 1 MONTH) - {SEASONAL[0]}) / {float(SEASONAL[1] - SEASONAL[0])!r}) AS hi, CASE month(s) WHEN 1 THEN 0.7 WHEN 2 THEN 0.85 WHEN 10 THEN 0.8 WHEN 11 THEN 1.8 WHEN 12 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2025-06-01', INTERVAL 1 MONTH)) AS s)),
mass AS (SELECT first, w * ({GROWN.format(t='hi')} - {GROWN.format(t='lo')}) AS x FROM m),
cum AS (SELECT first, (sum(x) OVER (ORDER BY first) - x) / sum(x) OVER () AS c, sum(x) OVER (ORDER BY first) / sum(x) OVER () AS d, max(first) OVER () AS last FROM mass),
q AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) / greatest((SELECT count(*) FROM orders) - 1, 1)::DOUBLE AS q FROM orders)
SELECT (year(first) * 100 + month(first))::INT AS month, count(*) AS n FROM q JOIN cum ON q >= c AND (q < d OR first = last) GROUP BY 1"""


@query("seasonal_timeline", SEASON_SQL)
def seasonal_timeline(spark, sf_dir):
    """As many rows as there are orders, made along a growth that the year's months weigh, by month."""
    schema = Schema.of(Table("visit", (Column("id", "integer", primary=True), Column("created_at", "timestamp")), ("id",)))
    line = Timeline(*SEASONAL, growth="compound", rate=0.05, jitter=0.0, season="holiday")
    plan = TablePlan("visit", table(spark, sf_dir, "orders").count(), {"id": Field("row-number")}, timeline=line)
    day = F.date_from_unix_date(F.floor(F.unix_millis(F.col("created_at").cast("timestamp")) / 86_400_000).cast("int"))
    made = generate_tables(spark, Plan(schema, {"visit": plan}, SEED))["visit"]
    return made.groupBy((F.year(day) * 100 + F.month(day)).alias("month")).agg(F.count("*").alias("n"))


# The engine: a small plan with as many rows as the tables have, made by the generator; the SQL is written apart from it.


def engine(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the plan: customers (personas, a timeline, churn, nulls, rows that are set, a reference to another customer), orders
    (fan-out with cascades and churn), parts, suppliers, and the pairs of parts and suppliers."""
    c = Column
    schema = Schema.of(
        Table("customer", (c("id", "integer", primary=True), c("score", "integer", nullable=True), c("tier", "string"), c("referrer", "integer", nullable=True), c("created_at", "timestamp"), c("deleted_at", "timestamp", nullable=True)), ("id",), (ForeignKey(("referrer",), "customer", ("id",)),)),
        Table("orders", (c("id", "integer", primary=True), c("customer_id", "integer")), ("id",), (ForeignKey(("customer_id",), "customer", ("id",)),)),
        Table("part", (c("id", "integer", primary=True), c("code", "integer", unique=True), c("sku", unique=True)), ("id",)),
        Table("supplier", (c("id", "integer", primary=True), c("nation_id", "integer")), ("id",), (ForeignKey(("nation_id",), "nation", ("id",)),)),
        Table("nation", (c("id", "integer", primary=True),), ("id",)),
        Table("part_supplier", (c("part_id", "integer"), c("supplier_id", "integer")), ("part_id", "supplier_id"), (ForeignKey(("part_id",), "part", ("id",)), ForeignKey(("supplier_id",), "supplier", ("id",)))),
    )
    rows = {n: table(spark, sf_dir, n).count() for n in {"customer": ("customer", "orders"), "orders": ("customer", "orders"), "part": ("part",), "supplier": ("supplier", "nation"), "part_supplier": ("part", "supplier", "nation")}[name] if n != "orders"}
    number = {"id": Field("row-number")}
    big = Persona("big", 0.2, {"tier": "gold"}, {"orders": 3.0})
    plans = [
        TablePlan("customer", rows.get("customer"), number | {"score": Field("row-number", null_probability=0.15), "tier": Field("constant", {"value": "plain"})}, personas=(big, Persona("small", 0.8)), timeline=Timeline(TIME[0], TIME[1], jitter=0.02), churn_rate=0.05, rows=({"tier": "FIRST"}, {"tier": "SECOND", "score": -1})),
        TablePlan("orders", 0, number, count_per_parent={"kind": "uniformInt", "min": 1, "max": 5}),
        TablePlan("part", rows.get("part"), number | {"code": Field("uniformInt", {"min": 1, "max": UNIQUE}), "sku": Field("sku", {"length": 5})}),
        TablePlan("supplier", rows.get("supplier"), number),
        TablePlan("nation", rows.get("nation"), number),
        TablePlan("part_supplier", 0, {}),
    ]
    return generate_tables(spark, Plan(schema, {t.table: t for t in plans}, SEED), [name])[name]


TIME = (1704067200000, 1735689600000)
MONTH = 86_400_000 * 30.436875
PARENTS = ("'42'", "'orders'", "'__parent__'", "'customer'", "i::VARCHAR")
#: Customers by row number i, with the share q of the time at which they came and when they left.
CUSTOMERS = "(SELECT c_custkey AS i, (SELECT count(*) FROM customer) AS n FROM customer)"
CAME = f"(SELECT i, n, floor({TIME[0]}.0 + greatest(0, least(1, i / (n - 1)::DOUBLE + (u1 - 0.5) * 0.02)) * {float(TIME[1] - TIME[0])!r})::BIGINT AS came FROM {sql.draws(CUSTOMERS, 'i, n', (chr(39) + '42' + chr(39), chr(39) + 'customer' + chr(39), chr(39) + '__timeline__' + chr(39), 'i::VARCHAR'))})"
LEFT = f"(SELECT i, n, came, CASE WHEN gone < {TIME[1]} THEN floor(gone)::BIGINT END AS gone FROM (SELECT i, n, came, came + -ln(greatest(1 - u1, 1e-16)) / 0.05 * {MONTH!r}::DOUBLE AS gone FROM {sql.draws(CAME, 'i, n, came', (chr(39) + '42' + chr(39), chr(39) + 'customer' + chr(39), chr(39) + '__churn__' + chr(39), 'i::VARCHAR'))}))"
BIG = f"(SELECT i, u1 < 0.2 AS big FROM {sql.draws(CUSTOMERS, 'i', (chr(39) + '42' + chr(39), chr(39) + 'customer' + chr(39), chr(39) + '__persona__' + chr(39), 'i::VARCHAR'))})"


@query("churn_times", f"SELECT i + 1 AS id, came AS came_ms, gone AS left_ms FROM {LEFT}")
def churn_times(spark, sf_dir):
    made = engine(spark, sf_dir, "customer")
    return made.select(F.col("id").cast("long").alias("id"), F.unix_millis(F.col("created_at").cast("timestamp")).alias("came_ms"), F.unix_millis(F.col("deleted_at").cast("timestamp")).alias("left_ms"))


@query("null_injection", "SELECT i + 1 AS id, CASE WHEN i = 1 THEN -1 WHEN u1 >= 0.15 THEN i + 1 END AS score FROM " + sql.draws(CUSTOMERS, "i", ("'42'", "'customer'", "'__nullable__'", "'score'", "i::VARCHAR")))
def null_injection(spark, sf_dir):
    return engine(spark, sf_dir, "customer").select(F.col("id").cast("long").alias("id"), F.col("score").cast("long").alias("score"))


@query("row_overrides", f"SELECT i + 1 AS id, CASE WHEN i = 0 THEN 'FIRST' WHEN i = 1 THEN 'SECOND' WHEN big THEN 'gold' ELSE 'plain' END AS tier FROM {BIG}")
def row_overrides(spark, sf_dir):
    return engine(spark, sf_dir, "customer").select(F.col("id").cast("long").alias("id"), "tier")


@query("row_patches", "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'FIRST' WHEN 1 THEN 'SECOND' ELSE r_name END AS r_name FROM region")
def row_patches(spark, sf_dir):
    fixed = spark.createDataFrame([(0, "FIRST"), (1, "SECOND")], "r_regionkey int, r_name string")
    return stores.patch(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), fixed, "r_regionkey")


@query("self_reference", "SELECT i + 1 AS id, (i + 1 + floor(u1 * (n - 1))::BIGINT) % n + 1 AS referrer FROM " + sql.draws(CUSTOMERS, "i, n", ("'42'", "'customer'", "'__selfref__'", "i::VARCHAR")))
def self_reference(spark, sf_dir):
    return engine(spark, sf_dir, "customer").select(F.col("id").cast("long").alias("id"), F.col("referrer").cast("long").alias("referrer"))


@query("fanout_personas", f"SELECT i + 1 AS customer_id, CASE WHEN gone IS NULL THEN k ELSE greatest(1, floor(k * least(1.0, (gone - came) / greatest({TIME[1]} - came, 1)::DOUBLE) + 0.5)) END::BIGINT AS n FROM (SELECT i, floor((floor(u1 * 5) + 1) * CASE WHEN big THEN 3.0 ELSE 1.0 END + 0.5) AS k FROM {sql.draws(CUSTOMERS, 'i', PARENTS)} JOIN {BIG} USING (i)) JOIN {LEFT} USING (i)")
def fanout_personas(spark, sf_dir):
    """Orders of each customer: the persona's factor, tapered by churn."""
    return engine(spark, sf_dir, "orders").groupBy(F.col("customer_id").cast("long").alias("customer_id")).agg(F.count("*").alias("n"))


STRIDE = f"(SELECT min(x) FROM (SELECT unnest(range(1, 2 * (SELECT count(*) FROM supplier) + 2)) AS x) WHERE x >= 1 + floor({number(SEED, 'part_supplier', '__stride__')!r}::DOUBLE * (SELECT count(*) FROM supplier)) AND gcd(x, (SELECT count(*) FROM supplier)) = 1)"
PARTS = "(SELECT p_partkey AS p, (SELECT count(*) FROM supplier) AS size FROM part)"


@query("junction_pairs", f"SELECT p + 1 AS part_id, (start + k * {STRIDE}) % size + 1 AS supplier_id FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT a.p, a.size, least(floor(a.u1 * 5)::BIGINT + 1, a.size) AS n, floor(b.u1 * a.size)::BIGINT AS start FROM {sql.draws(PARTS, 'p, size', (chr(39) + '42' + chr(39), chr(39) + 'part_supplier' + chr(39), chr(39) + '__parent__' + chr(39), chr(39) + 'part' + chr(39), 'p::VARCHAR'))} a JOIN {sql.draws(PARTS, 'p', (chr(39) + '42' + chr(39), chr(39) + 'part_supplier' + chr(39), chr(39) + '__junction__' + chr(39), 'p::VARCHAR'))} b USING (p)))")
def junction_pairs(spark, sf_dir):
    """Pairs without repetition: for each part, steps of a stride that shares no factor with the number of suppliers."""
    return engine(spark, sf_dir, "part_supplier").select(F.col("part_id").cast("long").alias("part_id"), F.col("supplier_id").cast("long").alias("supplier_id"))


@query("engine_fk_pick", "SELECT r + 1 AS id, floor(u1 * (SELECT count(*) FROM nation))::BIGINT + 1 AS nation_id FROM " + sql.draws("(SELECT s_suppkey AS r FROM supplier)", "r", ("'42'", "'supplier'", "'__parent__'", "'nation'", "r::VARCHAR")))
def engine_fk_pick(spark, sf_dir):
    """A reference computed from the parent's row number, without a join."""
    return engine(spark, sf_dir, "supplier").select(F.col("id").cast("long").alias("id"), F.col("nation_id").cast("long").alias("nation_id"))


UNIQUE = 10_000_000


@query("unique_codes", f"SELECT p + 1 AS id, x + 1 AS code, (SELECT count(*) FROM part) AS codes, (SELECT count(*) FROM part) AS skus FROM {sql.permuted('(SELECT p_partkey AS p FROM part)', 'p', UNIQUE, ('42', 'part', '__unique__', 'code'))}")
def unique_codes(spark, sf_dir):
    """Unique numbers and texts: a permutation of the row's number, mapped to values; and how many different ones there are."""
    made = engine(spark, sf_dir, "part")
    different = made.agg(F.count_distinct("code").alias("codes"), F.count_distinct("sku").alias("skus"))
    return made.select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code")).join(F.broadcast(different))


NAME_SQL = f"{TITLE(one_of_sql(words.WORDS, 'u1'))} || ' ' || {TITLE(one_of_sql(words.WORDS, 'u2'))}"


@query("derived_columns", f"SELECT i + 1 AS id, name, replace(lower(name), ' ', '-') AS slug, name || '!' AS loud FROM (SELECT i, {NAME_SQL} AS name FROM {sql.draws('(SELECT p_partkey AS i FROM part)', 'i', (chr(39) + '42' + chr(39), chr(39) + 'part' + chr(39), chr(39) + '__row__' + chr(39), 'i::VARCHAR', chr(39) + 'name' + chr(39)), 2)})")
def derived_columns(spark, sf_dir):
    """Columns that are made of other generated columns, whatever the order in which they are declared."""
    schema = Schema.of(Table("part", (Column("id", "integer", primary=True), Column("slug"), Column("loud"), Column("name")), ("id",)))
    fields = {"slug": Field("derived-slug", {"sourceColumn": "name"}), "loud": Field("derived", {"fn": lambda columns, state, context: F.concat(columns["name"], F.lit("!"))}), "name": Field("word"), "id": Field("row-number")}
    plan = Plan(schema, {"part": TablePlan("part", table(spark, sf_dir, "part").count(), fields)}, SEED)
    return generate_tables(spark, plan)["part"].select(F.col("id").cast("long").alias("id"), "name", "slug", "loud")


@query("cloned_rows", f"SELECT id, {words.FIRST}[floor(u1 * {len(words.FIRST)})::INT + 1] || ' ' || {words.LAST}[floor(u2 * {len(words.LAST)})::INT + 1] AS full_name, segment FROM " + sql.draws("(SELECT c_custkey AS id, c_name, c_mktsegment AS segment FROM customer ORDER BY md5(c_custkey::VARCHAR || ':42'), c_custkey LIMIT 60)", "id, segment", ("'42'", "'__anonymize__'", "'fullName'", "sha256(c_name)"), 2))
def cloned_rows(spark, sf_dir):
    """A clone as JSON lines, with names replaced and keys kept; some rows of each table are its feature."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("segment"))
    schema, path = catalog.from_frames({"people": people}, {"people": {"primary_key": ["id"]}}), stores.scratch(spark, "clone")
    clone(spark, {"people": people}, schema, path, 60, SEED)
    return spark.read.schema("id long, full_name string, segment string").json(f"{path}/people")


@query("reset_rows", "SELECT r + 1 AS id, floor(u1 * 100)::BIGINT + 1 AS code FROM " + sql.draws("(SELECT s_suppkey AS r FROM supplier)", "r", ("'9'", "'supplier'", "'__row__'", "r::VARCHAR", "'code'")))
def reset_rows(spark, sf_dir):
    """Tables put back to what a lockfile's seed gives, in place of what has been added to them since."""
    schema = Schema.of(Table("supplier", (Column("id", "integer", primary=True), Column("code", "integer")), ("id",)))
    config = {"tables": {"supplier": {"count": table(spark, sf_dir, "supplier").count(), "columns": {"code": {"kind": "uniformInt", "min": 1, "max": 100}}}}}
    plan, path = build_plan(schema, config), stores.scratch(spark, "reset")
    stores.write_tables(spark, generate_tables(spark, plan), schema, path)
    stores.write_tables(spark, generate_tables(spark, plan), schema, path, "append")
    reset(spark, plan, drift.make_lock(replace(plan, seed=9), config, {}), path)
    return spark.read.parquet(f"{path}/supplier").select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code"))


class Halved:
    """A plugin that plans half of the rows, brings a generator on Arrow arrays, and leaves out some of what is made."""

    name = "halved"

    def register_generators(self, register) -> None:
        import pyarrow as pa

        @register_arrow("letter", "string", types=("string",), distinct=lambda p: 26)
        def letter(params, states):
            return pa.array([chr(65 + int(u * 26)) for u in random_numbers(states)])

    def before_generate(self, plan):
        return replace(plan, tables={n: replace(t, count=t.count // 2, fields=t.fields | {"letter": Field("letter")}) for n, t in plan.tables.items()})

    def after_generate(self, made):
        return {n: df.filter("id % 3 <> 0") for n, df in made.items()}


@query("plugged_rows", "SELECT i + 1 AS id, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', floor(u1 * 26)::INT + 1, 1) AS letter FROM " + sql.draws("(SELECT c_custkey AS i FROM customer)", "i", ("'42'", "'customer'", "'__row__'", "i::VARCHAR", "'letter'")) + " WHERE i < (SELECT count(*) // 2 FROM customer) AND (i + 1) % 3 <> 0")
def plugged_rows(spark, sf_dir):
    """What a plugin makes of a plan and of the tables that come of it, with a generator of its own."""
    plugin = Halved()
    plugin.register_generators(None)
    schema = Schema.of(Table("customer", (Column("id", "integer", primary=True), Column("letter")), ("id",)))
    plan = Plan(schema, {"customer": TablePlan("customer", table(spark, sf_dir, "customer").count(), {"id": Field("row-number")})}, SEED)
    return generate_tables(spark, plan, plugins=[plugin])["customer"].select(F.col("id").cast("long").alias("id"), "letter")


@query("replayed_rows", f"SELECT p + 1 AS id, x + 1 AS code FROM {sql.permuted('(SELECT p_partkey AS p FROM part)', 'p', UNIQUE, ('42', 'part', '__unique__', 'code'))}")
def replayed_rows(spark, sf_dir):
    """A bundle that keeps no rows gives, from its configuration and seed, those that it was exported from; import compares them."""
    schema = Schema.of(Table("part", (Column("id", "integer", primary=True), Column("code", "integer", unique=True)), ("id",)))
    config = {"seed": SEED, "tables": {"part": {"count": table(spark, sf_dir, "part").count(), "columns": {"code": {"kind": "uniformInt", "min": 1, "max": UNIQUE}}}}}
    plan, path = build_plan(schema, config), stores.scratch(spark, "bundle")
    stores.export_bundle(spark, path, schema, config, drift.make_lock(plan, config, {}), generate_tables(spark, plan), snapshot=False)
    return stores.import_bundle(spark, path, schema)["part"].select(F.col("id").cast("long").alias("id"), F.col("code").cast("long").alias("code"))


@query("bundled_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def bundled_rows(spark, sf_dir):
    """Rows that were exported as JSON lines and imported again, compared by count and hashes."""
    own = {n: table(spark, sf_dir, n) for n in ("nation", "region")}
    wide = {n: df.select(*[F.col(c).cast("long") if t == "int" else F.col(c) for c, t in df.dtypes]) for n, df in own.items()}
    schema, path = catalog.from_frames(wide, {n: KEYS[n] for n in own}), stores.scratch(spark, "bundle")
    stores.export_bundle(spark, path, schema, {}, {}, wide, "json")
    return stores.import_bundle(spark, path, schema)["nation"].select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


class Shout:
    """A plugin that changes the names of a batch on its way to the store."""

    name = "shout"

    def before_insert_batch(self, of: str, batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        upper = [pc.utf8_upper(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c for c in batch.columns]
        return pa.RecordBatch.from_arrays(upper, batch.schema.names)


@query("written_rows", "SELECT 'customer' AS \"table\", c_custkey AS id, upper(c_name) AS name, n AS copies FROM customer, (SELECT unnest([1, 2]) AS n) UNION ALL SELECT 'supplier', s_suppkey, upper(s_name), 1 FROM supplier")
def written_rows(spark, sf_dir):
    """Tables written as a whole, one of them added to, another replaced, past a plugin; and read again."""
    customer, supplier = (table(spark, sf_dir, n).select(F.col(k).alias("id"), F.col(v).alias("name"), F.lit(1).alias("copies")) for n, k, v in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name")))
    schema, path = Schema.of(*[Table(n, (Column("id", "integer"), Column("name"), Column("copies", "integer"))) for n in ("customer", "supplier")]), stores.scratch(spark, "written")
    stores.write_tables(spark, {"customer": customer, "supplier": supplier.union(supplier)}, schema, path, "fresh", plugins=[Shout()])
    stores.write_tables(spark, {"customer": customer.withColumn("copies", F.lit(2))}, schema, path, "append", plugins=[Shout()])
    stores.write_tables(spark, {"supplier": supplier}, schema, path, "truncate", plugins=[Shout()])
    return quality.union_all([spark.read.parquet(f"{path}/{n}").withColumn("table", F.lit(n)) for n in ("customer", "supplier")])


EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("streamed_upserts", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def streamed_upserts(spark, sf_dir):
    """Each user's last event, from a stream of all events that is put into a table batch by batch. The pattern lets the stream read a
    table of one file as well as one of many."""
    path = stores.scratch(spark, "stream")
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type")
    sink = sinks.upsert_sink(f"{path}/table", ["user_id"], "event_id", 8)
    events.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sinks.read_table(spark, f"{path}/table")


@query("streamed_counts", 'SELECT event_type AS "table", count(*) AS rows FROM events GROUP BY 1')
def streamed_counts(spark, sf_dir):
    """Rows by type of event, kept as a stream's state and put into a table."""
    path = stores.scratch(spark, "stream")
    events = spark.readStream.schema(EVENT).parquet(f"{sf_dir}/events.parquet*").select("event_type", "event_id")
    counts = sinks.running_counts(events, "event_type", 4)
    sink = sinks.upsert_sink(f"{path}/table", ["table", "part"], "batches", 4)
    counts.writeStream.foreachBatch(sink).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sinks.totals(sinks.read_table(spark, f"{path}/table"))


@query("previewed_rows", "SELECT i + 1 AS id, (i + 1 + floor(u1 * (n - 1))::BIGINT) % n + 1 AS referrer FROM " + sql.draws(CUSTOMERS, "i, n", ("'42'", "'customer'", "'__selfref__'", "i::VARCHAR")) + " WHERE i < 7")
def previewed_rows(spark, sf_dir):
    """The first rows of a plan as large as the table, computed alone: a preview is its feature."""
    schema = Schema.of(Table("customer", (Column("id", "integer", primary=True), Column("referrer", "integer", nullable=True)), ("id",), (ForeignKey(("referrer",), "customer", ("id",)),)))
    plan = Plan(schema, {"customer": TablePlan("customer", table(spark, sf_dir, "customer").count(), {"id": Field("row-number")})}, SEED)
    return preview(spark, plan, 7)["customer"].select(F.col("id").cast("long").alias("id"), F.col("referrer").cast("long").alias("referrer"))


def blank_sql(column: str, share: float, value: str) -> str:
    return f"SELECT i, CASE WHEN u1 >= {share} THEN {value} END AS {column} FROM " + sql.draws(CUSTOMERS, "i", ("'42'", "'customer'", "'__nullable__'", f"'{column}'", "i::VARCHAR"))


@query("nulls_by_type", f"SELECT i + 1 AS id, whole, text FROM ({blank_sql('whole', 0.1, 'i + 1')}) JOIN ({blank_sql('text', 0.15, repr('x'))}) USING (i)")
def nulls_by_type(spark, sf_dir):
    """Nulls of columns that were not configured, in shares by their types."""
    schema = Schema.of(Table("customer", (Column("id", "integer", primary=True), Column("whole", "integer", nullable=True), Column("text", nullable=True)), ("id",)))
    fields = {"id": Field("row-number"), "whole": Field("row-number", {}, "inferred"), "text": Field("constant", {"value": "x"}, "inferred")}
    plan = Plan(schema, {"customer": TablePlan("customer", table(spark, sf_dir, "customer").count(), fields)}, SEED, null_probability="by type")
    return generate_tables(spark, plan)["customer"].select(F.col("id").cast("long").alias("id"), F.col("whole").cast("long").alias("whole"), "text")


SIZED = ("customer", "supplier", "part")


@query("scaled_counts", f"WITH c AS ({' UNION ALL '.join(f'SELECT {chr(39)}{n}{chr(39)} AS t, count(*) AS n FROM {n}' for n in SIZED)}) SELECT t AS \"table\", greatest(1, floor(n * 5000 / (SELECT sum(n) FROM c)::DOUBLE + 0.5))::BIGINT AS n_rows FROM c")
def scaled_counts(spark, sf_dir):
    """Rows of a plan in proportion to the folder's tables, scaled to five thousand in all, and made."""
    tables_ = [Table(n, (Column("id", "integer", primary=True),), ("id",)) for n in SIZED]
    plan = Plan(Schema.of(*tables_), {n: TablePlan(n, table(spark, sf_dir, n).count(), {"id": Field("row-number")}) for n in SIZED}, SEED).scaled(5000)
    return quality.union_all([df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in generate_tables(spark, plan).items()])


@query("unique_conflicts", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def unique_conflicts(spark, sf_dir):
    return quality.key_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("generated_shop")
def generated_shop(spark, sf_dir):
    """Row counts, orphans and repeated keys of a generated shop of six tables, as large as the tables of the folder."""
    from weftline.plans.shop import shop_plan

    plan = shop_plan(*(table(spark, sf_dir, n).count() for n in ("customer", "part", "supplier")))
    made = generate_tables(spark, plan)
    report = quality.reference_report(made, plan.schema).groupBy("child").agg(F.sum("n_orphans").alias("orphans"))
    keys = quality.union_all([quality.key_violations(made[n], list(t.primary_key)).agg(F.count("*").alias("repeated")).withColumn("table", F.lit(n)) for n, t in plan.schema.tables.items()])
    rows = quality.union_all([df.agg(F.count("*").alias("n_rows")).withColumn("table", F.lit(n)) for n, df in made.items()])
    return rows.join(keys, "table").join(report, F.col("child") == F.col("table"), "left").select("table", "n_rows", "repeated", F.coalesce("orphans", F.lit(0)).alias("orphans"))


# Quality


#: Rows that the tables of the folder should have: exactly, or within a range.
EXPECTED = {"region": (5, 5), "nation": (25, 25), "customer": (1, 1000), "supplier": (1, 10**9), "part": (500, 10**9), "orders": (1, 10**12), "lineitem": (1, 10**12)}


@query("verify_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, {lo}::BIGINT AS at_least, {hi}::BIGINT AS at_most, count(*) BETWEEN {lo} AND {hi} AS ok FROM {t}" for t, (lo, hi) in EXPECTED.items()))
def verify_row_counts(spark, sf_dir):
    return quality.row_counts(spark, tables(spark, sf_dir), EXPECTED)


@query("verify_references", " UNION ALL ".join(f"SELECT '{t}' AS child, '{c}' AS \"column\", '{p}' AS parent, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM {t} WHERE {c} IS NULL) AS n_null, (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} WHERE {p}.{k} = {t}.{c})) AS n_orphans" for t, d in KEYS.items() for c, (p, k) in d.get("foreign_keys", {}).items()))
def verify_references(spark, sf_dir):
    all_tables = tables(spark, sf_dir)
    return quality.reference_report(all_tables, catalog.from_frames(all_tables, KEYS))


COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal", "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
}
CELLS = [(t, c) for t, columns in COLUMNS.items() for c in columns.split()]


@query("profile_null_rates", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_null, (count(*) - count({c})) / count(*) AS null_rate FROM {t}" for t, c in CELLS))
def profile_null_rates(spark, sf_dir):
    return quality.union_all([quality.null_rates(df, n) for n, df in tables(spark, sf_dir).items()])


@query("profile_distinct", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(*) = count(DISTINCT {c}) AS \"unique\" FROM {t}" for t, c in CELLS if t in ("customer", "part", "orders")))
def profile_distinct(spark, sf_dir):
    """All columns of a table in one scan."""
    return quality.union_all([quality.distinct_counts(table(spark, sf_dir, n), n) for n in ("customer", "part", "orders")])


def keys_sql(name: str, columns: list[str], most: int = 3) -> str:
    """The smallest sets of columns without nulls and repetitions, by counting every set."""
    from itertools import combinations

    sets = [x for n in range(1, most + 1) for x in combinations(columns, n)]
    whole = lambda x: " AND ".join(f"{c} IS NOT NULL" for c in x)
    each = " UNION ALL ".join(f"SELECT {list(x)} AS s, count(*) AS n_rows, count(DISTINCT ({', '.join(x)})) FILTER ({whole(x)}) AS n_distinct, count_if(NOT ({whole(x)})) AS nulls FROM {name}" for x in sets)
    return f"WITH k AS (SELECT * FROM ({each}) WHERE n_rows = n_distinct AND nulls = 0 AND n_rows > 0) SELECT '{name}' AS \"table\", array_to_string(s, ',') AS columns, n_rows, n_distinct FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE len(o.s) < len(k.s) AND list_has_all(k.s, o.s))"


@query("profile_candidate_keys", keys_sql("conversations", ["conv_id", "turn", "role", "text"]))
def profile_candidate_keys(spark, sf_dir):
    return quality.candidate_keys(table(spark, sf_dir, "conversations"), "conversations")


@query("profile_keys_lineitem", keys_sql("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]))
def profile_keys_lineitem(spark, sf_dir):
    """Keys of up to three of a table's columns, found by sketches of all sets in one scan."""
    return quality.candidate_keys(table(spark, sf_dir, "lineitem"), "lineitem")


@query("profile_domain", "SELECT o_orderpriority AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1")
def profile_domain(spark, sf_dir):
    return quality.domain(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("enum_violations", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def enum_violations(spark, sf_dir):
    return quality.outside(table(spark, sf_dir, "events"), "event_type", ["click", "view"])


@query("check_violations", "SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 5 AND 40)")
def check_violations(spark, sf_dir):
    return quality.check_violations(table(spark, sf_dir, "part"), "p_size BETWEEN 5 AND 40").select("p_partkey", "p_size")


@query("infer_inclusion", "SELECT count(*) AS n_distinct, count(k) AS n_found, count(k) / count(*) AS ratio FROM (SELECT DISTINCT user_id AS v FROM events WHERE user_id IS NOT NULL) LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer) ON v = k")
def infer_inclusion(spark, sf_dir):
    return graph.inclusion(table(spark, sf_dir, "events"), "user_id", table(spark, sf_dir, "customer"), "c_custkey")


@query("infer_keys", "SELECT 'labels' AS child, 'doc_id' AS \"column\", 'docs' AS parent, 'doc_id' AS key, count(*) AS n_distinct, count(k) AS n_found, count(k) / count(*) AS ratio FROM (SELECT DISTINCT doc_id AS v FROM labels) LEFT JOIN (SELECT DISTINCT doc_id AS k FROM documents) ON v = k")
def infer_keys(spark, sf_dir):
    named = {"docs": table(spark, sf_dir, "documents"), "labels": table(spark, sf_dir, "labels")}
    return graph.inferred_keys(named, {"docs": "doc_id"})


WHOLE = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}
TEXTS = {t: [c for c in columns.split() if c in ("r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus")] for t, columns in COLUMNS.items()}


def inclusions_sql(columns: dict[str, list[str]], kind: str, least: float) -> str:
    values = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {c}::{kind} AS v FROM {t} WHERE {c} IS NOT NULL" for t, cs in columns.items() for c in cs)
    return f"(WITH v AS ({values}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL) SELECT a.t AS child, a.c AS \"column\", b.t AS parent, b.c AS key, any_value(n.n) AS n_distinct, count(*) AS n_found, count(*) / any_value(n.n) AS ratio FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) JOIN n ON n.t = a.t AND n.c = a.c GROUP BY ALL HAVING count(*) >= {least} * any_value(n.n))"


@query("infer_all_inclusions", inclusions_sql(WHOLE, "BIGINT", 0.9) + " UNION ALL " + inclusions_sql(TEXTS, "VARCHAR", 0.9))
def infer_all_inclusions(spark, sf_dir):
    """Which columns of whole numbers or texts, of all tables, lie in which others to nine tenths: one shuffle for all pairs."""
    return graph.inclusions(tables(spark, sf_dir), 0.9)


# Metadata


def schema_of(spark, sf_dir) -> Schema:
    return catalog.from_frames(tables(spark, sf_dir), KEYS)


@query("fk_levels", "WITH RECURSIVE fk(child, parent) AS (VALUES ('nation', 'region'), ('customer', 'nation'), ('supplier', 'nation'), ('orders', 'customer'), ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier')), t(name) AS (SELECT child FROM fk UNION SELECT parent FROM fk), walk(name, depth) AS (SELECT name, 0 FROM t WHERE name NOT IN (SELECT child FROM fk) UNION SELECT fk.child, depth + 1 FROM walk JOIN fk ON fk.parent = walk.name) SELECT name AS \"table\", max(depth)::INT AS level FROM walk GROUP BY 1")
def fk_levels(spark, sf_dir):
    rows = [(n, i) for i, level in enumerate(graph.build(schema_of(spark, sf_dir)).levels) for n in level]
    return spark.createDataFrame(rows, "table string, level int")


@query("semantic_meanings", "SELECT * FROM (VALUES ('customer', 'c_acctbal', 'currency'), ('lineitem', 'l_extendedprice', 'currency'), ('lineitem', 'l_shipdate', 'timestamp'), ('orders', 'o_orderdate', 'timestamp'), ('orders', 'o_totalprice', 'currency'), ('part', 'p_retailprice', 'currency'), ('part', 'p_size', 'quantity'), ('supplier', 's_acctbal', 'currency')) t(\"table\", \"column\", meaning)")
def semantic_meanings(spark, sf_dir):
    found = [(m.table, m.column, m.meaning) for m in analyze(schema_of(spark, sf_dir)) if m.meaning and m.meaning not in ("foreignKey",)]
    return spark.createDataFrame(found, "table string, column string, meaning string")


def changed(schema: Schema) -> Schema:
    """The folder's schema with declared changes: a table and a column less, a column more, another type, another nullability, a new table."""
    out = dict(schema.tables)
    del out["region"]
    new = lambda t, change: replace(t, columns=tuple(x for c in t.columns if (x := change(c))))
    out["nation"] = replace(out["nation"], foreign_keys=())
    out["customer"] = new(out["customer"], lambda c: None if c.name == "c_acctbal" else c)
    out["part"] = new(out["part"], lambda c: replace(c, type="string") if c.name == "p_size" else c)
    out["supplier"] = new(out["supplier"], lambda c: replace(c, nullable=not c.nullable) if c.name == "s_name" else c)
    out["orders"] = replace(out["orders"], columns=(*out["orders"].columns, Column("o_channel", "string")))
    out["returns"] = Table("returns", (Column("id", "integer", primary=True),), ("id",))
    return Schema(out, schema.dialect)


TYPE_SQL = "CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'float' WHEN data_type = 'VARCHAR' THEN 'string' END"
OF_TABLE = lambda t, c: f"FROM information_schema.columns WHERE table_name = '{t}' AND column_name = '{c}'"


@query("schema_diff", f"""SELECT 'region' AS "table", NULL AS "column", 'table removed' AS change, NULL AS was, NULL AS now FROM information_schema.tables WHERE table_name = 'region'
UNION ALL SELECT 'returns', NULL, 'table added', NULL, NULL
UNION ALL SELECT table_name, column_name, 'column removed', {TYPE_SQL}, NULL {OF_TABLE('customer', 'c_acctbal')}
UNION ALL SELECT table_name, column_name, 'type changed', {TYPE_SQL}, 'string' {OF_TABLE('part', 'p_size')}
UNION ALL SELECT table_name, column_name, 'nullability changed', lower(CASE is_nullable WHEN 'YES' THEN 'true' ELSE 'false' END), lower(CASE is_nullable WHEN 'YES' THEN 'false' ELSE 'true' END) {OF_TABLE('supplier', 's_name')}
UNION ALL SELECT 'orders', 'o_channel', 'column added', NULL, 'string'""")
def schema_diff(spark, sf_dir):
    """The schema of the folder's tables against one with declared changes."""
    schema = schema_of(spark, sf_dir)
    return drift.diff_columns(drift.columns_frame(spark, schema), drift.columns_frame(spark, changed(schema)))


@query("import_compat", "SELECT 'region' AS missing, (SELECT count(*) FROM region) AS n_rows UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem)")
def import_compat(spark, sf_dir):
    """Tables of a bundle of the folder that a target lacks, and how many rows would find no place."""
    schema = schema_of(spark, sf_dir)
    target = Schema({n: t for n, t in schema.tables.items() if n not in ("region", "lineitem")})
    missing = stores.check_import({"tables": list(schema.tables), "schemaHash": "x"}, target).missing
    return quality.union_all([table(spark, sf_dir, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("missing"), "n_rows") for n in missing])


@query("preflight_findings", """SELECT CASE WHEN max(p_size) - min(p_size) + 1 < 0.1 * count(*) THEN 'error' ELSE 'warning' END AS level, 'part' AS "table", 'p_size' AS "column" FROM part HAVING max(p_size) - min(p_size) + 1 < count(*)
UNION ALL SELECT 'error', 'orders', 'o_orderpriority' WHERE 'NONE' NOT IN (SELECT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL)""")
def preflight_findings(spark, sf_dir):
    """A plan as large as the folder's tables, with a unique column of the numbers that p_size spans and an enum of the priorities that
    occur: what would go wrong."""
    part, orders = table(spark, sf_dir, "part"), table(spark, sf_dir, "orders")
    size = part.agg(F.count("*").alias("n"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi")).first()
    priorities = tuple(sorted(r["value"] for r in quality.domain(orders, "o_orderpriority").filter("value is not null").collect()))
    key = lambda n: Column(n, "integer", primary=True)
    schema = Schema.of(Table("part", (key("p_partkey"), Column("p_size", "integer", unique=True)), ("p_partkey",)), Table("orders", (key("o_orderkey"), Column("o_orderpriority", "enum", enum_values=priorities)), ("o_orderkey",)))
    config = {"part": {"count": size["n"], "columns": {"p_size": {"kind": "uniformInt", "min": size["lo"], "max": size["hi"]}}}, "orders": {"count": 10, "columns": {"o_orderpriority": {"kind": "enum", "values": [*priorities, "NONE"]}}}}
    found = preflight(build_plan(schema, {"tables": config}))
    return spark.createDataFrame([(f.level, f.table, f.column) for f in found], "level string, table string, column string")


# Sources, clones and writes


@query("json_schema", "SELECT 'events' AS \"table\", 'k' AS \"column\", 'integer' AS type, (SELECT count(*) FROM events WHERE props IS NOT NULL AND json_extract(props, '$.k') IS NULL) > 0 AS nullable")
def json_schema(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("props").alias("value"))
    found = catalog.from_documents({"events": events}).tables["events"].columns
    return spark.createDataFrame([("events", c.name, c.type, c.nullable) for c in found], "table string, column string, type string, nullable boolean")


MIXED = """CASE event_type WHEN 'click' THEN 'integer' WHEN 'view' THEN 'float' ELSE 'string' END"""


@query("document_types", f"""WITH k AS (SELECT {MIXED} AS kind, count(*) AS n FROM events GROUP BY 1), b AS (SELECT sum(n)::BIGINT AS n, count(*) AS kinds, max_by(kind, n * 10 + CASE kind WHEN 'string' THEN 2 WHEN 'integer' THEN 1 ELSE 0 END) AS majority, max(n) / sum(n)::DOUBLE AS share, bool_or(kind = 'string') AS texts FROM k)
SELECT 'id' AS path, (SELECT count(*) FROM events) AS n, 'integer' AS majority, 1.0::DOUBLE AS share, 'integer' AS type, false AS conflict UNION ALL SELECT 'props', count(*), 'object', 1.0, 'object', false FROM events
UNION ALL SELECT 'props.k', count(*), 'integer', 1.0, 'integer', false FROM events UNION ALL SELECT 'v', n, majority, share, CASE WHEN texts AND kinds > 1 THEN 'string' WHEN kinds > 1 THEN 'float' ELSE majority END, texts AND kinds > 1 FROM b""")
def document_types(spark, sf_dir):
    """The types of the paths of documents made of events, in which one path holds numbers and texts."""
    value = F.when(F.col("event_type") == "click", F.col("event_id").cast("string")).when(F.col("event_type") == "view", "1.5").otherwise('"text"')
    text = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "v": '), value, F.lit(', "props": '), F.col("props"), F.lit("}"))
    return documents.document_types(table(spark, sf_dir, "events").select(text.alias("value")))


@query("sample_rows", "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey::VARCHAR || ':42'), c_custkey LIMIT 100")
def sample_rows(spark, sf_dir):
    return anonymize.sample(table(spark, sf_dir, "customer"), "c_custkey", 100).select("c_custkey", "c_name")


@query("anonymize_customer", f"SELECT c_custkey, {words.FIRST}[floor(u1 * {len(words.FIRST)})::INT + 1] || ' ' || {words.LAST}[floor(u2 * {len(words.LAST)})::INT + 1] AS c_name, c_mktsegment FROM " + sql.draws("customer", "c_custkey, c_mktsegment", ("'42'", "'__anonymize__'", "'fullName'", "sha256(c_name)"), 2))
def anonymize_customer(spark, sf_dir):
    return anonymize.anonymize(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "fullName"}, SEED)


@query("progress_rows", "SELECT event_id, event_type, sum(1) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS written FROM events")
def progress_rows(spark, sf_dir):
    batches = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(1).cast("long").alias("rows"))
    return stores.running_rows(batches, "event_id", "event_type").select("event_id", "event_type", "written")


@query("upsert_customers", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_customers(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(1).alias("version"))
    new = old.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("changed").alias("c_mktsegment"), F.lit(2).alias("version"))
    return stores.upsert(old, new, ["c_custkey"], "version").drop("version")
