"""Masking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import hashing, masking as m
from millrace.functions.registry import Policy, Rule, sync_rules
from millrace.functions.text import concat_names, merge_json, split_full_name
from millrace.plans.base import query
from millrace.sources.catalog import table


def _int(hexa: str) -> str:
    """DuckDB: eight hex digits as a number."""
    return f"CAST(('0x' || substr({hexa}, 1, 8)) AS BIGINT)"


def _sha(value: str, seed: str | None = None) -> str:
    return f"sha256({value})" if seed is None else f"sha256('{seed}:' || {value})"


_SYNC_SQL = f"""
  'User ' || upper(substr(sha256(c_name), 1, 4)) AS c_name, 'user_' || substr(sha256(c_name), 1, 8) || '@example.com' AS email,
  '+1-555-' || CAST({_int('sha256(c_name)')} % 10000 AS VARCHAR) AS phone"""


@query(f"SELECT c_custkey, {_SYNC_SQL}, c_acctbal FROM customer")
def sync_mask_customer(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", m.sync_name(c).alias("c_name"), m.sync_email(c).alias("email"), m.sync_phone(c).alias("phone"), "c_acctbal")


@query(f"""SELECT c_custkey, {_SYNC_SQL}, count(o_orderkey)::BIGINT AS n_orders
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, customer.c_name""")
def flagship_masked_customers(spark, d):
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    j = sync_mask_customer(spark, d).join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", "c_name", "email", "phone", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS order_hash, substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) AS customer_hash, o_totalprice FROM orders")
def sync_hash_keys(spark, d):
    return table(spark, d, "orders").select(m.sync_hash(F.col("o_orderkey")).alias("order_hash"), m.sync_hash(F.col("o_custkey")).alias("customer_hash"), "o_totalprice")


@query("""SELECT o_orderkey, CASE WHEN o_custkey IS NULL THEN NULL ELSE '[REDACTED]' END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN NULL ELSE '[REDACTED]' END AS o_orderpriority FROM orders""")
def sync_redact_cols(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return Policy({"orders": sync_rules({"o_custkey": "redact", "o_orderpriority": "no such strategy", "absent": "hash"})}).apply("orders", df)


@query(f"SELECT c_custkey, 'user_' || substr({_sha('c_name', '42')}, 1, 8) || '@example.com' AS email FROM customer")
def mask_email_seeded(spark, d):
    return table(spark, d, "customer").select("c_custkey", m.mask_email(F.col("c_name"), 42).alias("email"))


_MAIL = "replace(lower(c_name), '#', '.') || '@' || lower(c_mktsegment) || '.test'"


@query(f"SELECT c_custkey, 'user_' || substr({_sha(_MAIL, '7')}, 1, 8) || '@' || lower(c_mktsegment) || '.test' AS email FROM customer")
def mask_email_keep_domain(spark, d):
    mail = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".test"))
    return table(spark, d, "customer").select("c_custkey", m.mask_email(mail, 7, keep_domain=True).alias("email"))


@query(f"SELECT c_custkey, '+1-555-' || lpad(CAST({_int(_sha('c_name', '42'))} % 10000 AS VARCHAR), 4, '0') AS phone FROM customer")
def mask_phone_seeded(spark, d):
    return table(spark, d, "customer").select("c_custkey", m.mask_phone(F.col("c_name"), 42).alias("phone"))


_IPAD, _OPAD = (p.hex() for p in hashing.pads(b"42s3cret"))


@query(f"SELECT c_custkey, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(c_name)))) AS h, substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(c_name)))), 1, 12) AS h12 FROM customer")
def mask_hmac_sha256(spark, d):
    c = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", m.mask_hash(c, 42, "s3cret").alias("h"), m.mask_hash(c, 42, "s3cret", length=12).alias("h12"))


@query("SELECT s_suppkey, sha256('pepper:' || s_name) AS h256, md5('pepper:' || s_name) AS h_md5, sha1('pepper:' || s_name) AS h_sha1 FROM supplier")
def mask_salted_hash(spark, d):
    h = lambda a: m.mask_salted(F.col("s_name"), "pepper", algorithm=a, keyed=False)
    return table(spark, d, "supplier").select("s_suppkey", h("sha256").alias("h256"), h("md5").alias("h_md5"), h("sha1").alias("h_sha1"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""SELECT c_custkey, ({_list(m.GIVEN)})[{_int(_sha('c_name', '1'))} % {len(m.GIVEN)} + 1] || ' ' || ({_list(m.FAMILY)})[{_int(_sha('c_name', '1:family'))} % {len(m.FAMILY)} + 1] AS c_name FROM customer""")
def mask_name_pick(spark, d):
    return table(spark, d, "customer").select("c_custkey", m.mask_name(F.col("c_name"), 1).alias("c_name"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1])), '.') || '.' AS initials FROM nation")
def mask_name_initials(spark, d):
    return table(spark, d, "nation").select("n_nationkey", m.mask_name(F.col("n_name"), style="initials").alias("initials"))


_DAY = "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"


@query(f"SELECT o_orderkey, make_date(year(o_orderdate), (1 + {_int(_sha(_DAY, '5'))} % 12)::INT, (1 + ({_int(_sha(_DAY, '5'))} // 12) % 28)::INT) AS d FROM orders")
def mask_date_year(spark, d):
    return table(spark, d, "orders").select("o_orderkey", m.mask_date(F.col("o_orderdate"), 5, "year").alias("d"))


@query(f"SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), (1 + {_int(_sha(_DAY, '5'))} % 28)::INT) AS d FROM orders")
def mask_date_month(spark, d):
    return table(spark, d, "orders").select("o_orderkey", m.mask_date(F.col("o_orderdate"), 5, "month").alias("d"))


@query(f"SELECT o_orderkey, CAST(o_orderdate AS DATE) + ({_int(_sha(_DAY, '5'))} % 61 - 30)::INT AS d FROM orders")
def mask_date_jitter(spark, d):
    return table(spark, d, "orders").select("o_orderkey", m.mask_date(F.col("o_orderdate"), 5, jitter_days=30).alias("d"))


_STREET = "s_suppkey || ' ' || s_name"


@query(f"""SELECT s_suppkey, CAST(1 + CAST(('0x' || substr({_sha(_STREET, '3')}, 9, 4)) AS BIGINT) % 999 AS VARCHAR) || ' ' || ({_list(m.STREETS)})[{_int(_sha(_STREET, '3'))} % 8 + 1]
  || ', City ' || s_nationkey || ', ' || ({_list(m.STATES)})[{_int(_sha("'NY'", '3'))} % 8 + 1] || ', ' || lpad(CAST({_int(_sha("CAST(10000 + s_suppkey AS VARCHAR)", '3'))} % 100000 AS VARCHAR), 5, '0') AS address FROM supplier""")
def mask_address_parts(spark, d):
    a = F.concat_ws(", ", F.concat_ws(" ", F.col("s_suppkey").cast("string"), "s_name"), F.concat(F.lit("City "), F.col("s_nationkey").cast("string")), F.lit("NY"), (10000 + F.col("s_suppkey")).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", m.mask_address(a, 3).alias("address"))


_CARD = "('4' || lpad(CAST(p_partkey * 7919 AS VARCHAR), 15, '0'))"
_LUHN = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST({0}[i] AS INT) > 4 THEN CAST({0}[i] AS INT) * 2 - 9 ELSE CAST({0}[i] AS INT) * 2 END ELSE CAST({0}[i] AS INT) END)) % 10 = 0)"


def _card():
    return F.concat(F.lit("4"), F.lpad((F.col("p_partkey") * 7919).cast("string"), 15, "0"))


@query(f"SELECT p_partkey, c AS card, {_LUHN.format('c')} AS valid FROM (SELECT p_partkey, {_CARD} AS c FROM part)")
def luhn_check(spark, d):
    return table(spark, d, "part").select("p_partkey", _card().alias("card"), m.luhn_valid(_card()).alias("valid"))


_BODY = "".join(f" || CAST(CAST(('0x' || substr(h, {1 + 3 * i}, 3)) AS BIGINT) % 10 AS VARCHAR)" for i in range(11))[4:]


@query(f"""WITH c AS (SELECT p_partkey, {_CARD} AS card FROM part), h AS (SELECT *, {_sha('card', '9')} AS h FROM c),
  t AS (SELECT p_partkey, card, {_BODY} AS b FROM h), x AS (SELECT p_partkey, card, b || CAST(n AS VARCHAR) || right(card, 4) AS new FROM t, range(10) r(n))
  SELECT p_partkey, new AS masked FROM x WHERE {_LUHN.format('new')}""")
def mask_card_luhn(spark, d):
    return table(spark, d, "part").select("p_partkey", m.mask_card(_card(), 9).alias("masked"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'amex' WHEN 3 THEN 'discover' WHEN 4 THEN 'diners' ELSE 'unknown' END AS card_type FROM part""")
def card_type_detect(spark, d):
    k = F.col("p_partkey") % 6
    n = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    number = F.when(k == 0, F.concat(F.lit("4000"), n)).when(k == 1, F.concat(F.lit("5500"), n)).when(k == 2, F.concat(F.lit("370"), n)).when(k == 3, F.concat(F.lit("6011"), n)).when(k == 4, F.concat(F.lit("36"), n)).otherwise(F.concat(F.lit("9000"), n))
    return table(spark, d, "part").select("p_partkey", m.card_type(number).alias("card_type"))


_IP = "(10 + user_id % 90) || '.' || (user_id // 7 % 256) || '.' || (user_id // 3 % 256) || '.' || (user_id % 256)"


@query(f"""WITH e AS (SELECT event_id, 10 + user_id % 90 AS a, {_IP} AS ip FROM events), h AS (SELECT event_id, ip, a, {_int(_sha('ip', '4'))} & 16777215 AS low FROM e)
  SELECT event_id, ip, a || '.' || (low >> 16) || '.' || ((low >> 8) & 255) || '.' || (low & 255) AS masked FROM h""")
def mask_ip_subnet(spark, d):
    u = F.col("user_id")
    ip = F.concat_ws(".", *[x.cast("string") for x in (10 + u % 90, F.floor(u / 7) % 256, F.floor(u / 3) % 256, u % 256)])
    return table(spark, d, "events").select("event_id", ip.alias("ip"), m.mask_ip(ip, 4).alias("masked"))


@query("""SELECT c_custkey, left(c_name, 2) || regexp_replace(substr(c_name, 3, length(c_name) - 6), '[A-Za-z0-9]', '*', 'g') || right(c_name, 4) AS c_name FROM customer""")
def mask_retention_tail(spark, d):
    return table(spark, d, "customer").select("c_custkey", m.mask_retention(F.col("c_name"), 2, 4).alias("c_name"))


_USED = ["email", "phone_us", "credit_card", "ipv4"]


def _redact_sql(column: str, names: list[str]) -> str:
    out = column
    for n in names:
        out = f"regexp_replace({out}, '{m.PATTERNS[n]}', '[REDACTED]', 'gi')"
    return out


@query(f"SELECT doc_id, {_redact_sql('text', _USED)} AS text FROM documents")
def redact_text_pii(spark, d):
    return table(spark, d, "documents").select("doc_id", m.mask_text(F.col("text"), _USED).alias("text"))


@query(f"SELECT page_id, {_redact_sql('url', ['url'])} AS url, regexp_replace('ftp://u' || page_id || ':pw@host/x', '^([A-Za-z][A-Za-z0-9+.-]*://[^:/@?#]*):[^@/]*@', '\\1:***@') AS safe, 'pw' AS password FROM pages")
def redact_page_urls(spark, d):
    u = F.concat(F.lit("ftp://u"), F.col("page_id").cast("string"), F.lit(":pw@host/x"))
    return table(spark, d, "pages").select("page_id", m.mask_text(F.col("url"), ["url"]).alias("url"), m.redact_url(u).alias("safe"), m.url_password(u).alias("password"))


@query("SELECT DISTINCT o_orderstatus, true AS total_near, true AS n_near FROM orders")
def dp_noisy_totals(spark, d):
    """Totals per status with Laplace noise, and whether they are within 40 scales of the true ones; the budget of
    this release is charged on the driver before the query runs.  The noise has no seed that could be known."""
    t = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    m.PrivacyBudget(10.0).charge(2, 1.0)
    t = t.select("*", m.dp_noise(F.col("total"), 1.0, 1e5).alias("x"), m.dp_noise(F.col("n").cast("double"), 1.0, 1.0).alias("y"))
    return t.select("o_orderstatus", (F.abs(F.col("x") - F.col("total")) < 40e5).alias("total_near"), (F.abs(F.col("y") - F.col("n")) < 40).alias("n_near"))


@query(f"""SELECT c.n_raw, c.n_masked FROM (SELECT (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS n_raw,
  (SELECT count(*) FROM orders JOIN customer ON substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) = substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16)) AS n_masked) c""")
def masked_keys_still_join(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    raw = o.join(c, F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("n_raw"))
    rule = lambda k: Policy({"t": [Rule(k, "sync_hash")]})
    mo, mc = rule("o_custkey").apply("t", o.select("o_custkey")), rule("c_custkey").apply("t", c.select("c_custkey"))
    masked = mo.join(mc, F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("n_masked"))
    return raw.join(masked)  # one row each


_FULL = "CASE WHEN c_custkey % 10 = 0 THEN 'Cher' WHEN c_custkey % 10 = 1 THEN '' ELSE 'Ann' || c_custkey || ' Lee ' || c_mktsegment END"


def _full():
    k = F.col("c_custkey") % 10
    return F.when(k == 0, "Cher").when(k == 1, "").otherwise(F.concat(F.lit("Ann"), F.col("c_custkey").cast("string"), F.lit(" Lee "), F.col("c_mktsegment")))


_SPLIT = f"""WITH f AS (SELECT c_custkey, {_FULL} AS full_name FROM customer),
  s AS (SELECT *, CASE WHEN contains(full_name, ' ') THEN regexp_extract(full_name, '^(.+) [^ ]+$', 1) ELSE full_name END AS first_name,
    CASE WHEN contains(full_name, ' ') THEN regexp_extract(full_name, '[^ ]+$') ELSE '' END AS last_name FROM f)"""


@query(_SPLIT + " SELECT c_custkey, first_name, last_name FROM s")
def split_full_name_q(spark, d):
    first, last = split_full_name(_full())
    return table(spark, d, "customer").select("c_custkey", first.alias("first_name"), last.alias("last_name"))


@query(_SPLIT + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE trim(concat_ws(' ', first_name, last_name)) = trim(full_name)) AS n_equal, round(100.0 * count(*) FILTER (WHERE trim(concat_ws(' ', first_name, last_name)) = trim(full_name)) / nullif(count(*), 0), 2)::DOUBLE AS accuracy FROM s")
def recombine_accuracy(spark, d):
    from millrace.operators.audit import percentage

    first, last = split_full_name(_full())
    ok = F.count_if(concat_names(first, last) == F.trim(_full()))
    return table(spark, d, "customer").agg(F.count("*").alias("n_rows"), ok.alias("n_equal")).withColumn("accuracy", percentage(F.col("n_equal"), F.col("n_rows")).cast("double"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, string_split(p_name, ' ')[-1] AS last_word, len(string_split(p_name, ' '))::INT AS n_words FROM part")
def split_part_array(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), F.element_at(w, -1).alias("last_word"), F.size(w).alias("n_words"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(event_id % 5 AS VARCHAR) AS v FROM events")
def json_merge_props(spark, d):
    extra = F.to_json(F.struct((F.col("event_id") % 5).cast("string").alias("v")))
    j = merge_json(F.col("props"), extra)
    return table(spark, d, "events").select("event_id", F.get_json_object(j, "$.k").alias("k"), F.get_json_object(j, "$.v").alias("v"))
