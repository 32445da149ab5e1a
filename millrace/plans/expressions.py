"""Scalar expressions, function families and user-defined functions.

Sessions run with ANSI arithmetic. Where an expression is meant to give NULL on
bad input it says so with a ``try_`` function.
"""

from pyspark.sql import functions as F

from millrace.functions import casting, user_defined
from millrace.plans.registry import query


@query(
    "arith_ops",
    """SELECT l_orderkey, l_quantity + 1 AS plus, l_quantity - 1 AS minus, l_quantity * l_tax AS times,
              l_extendedprice / l_quantity AS over, l_linenumber % 3 AS rem, -l_linenumber AS neg,
              +l_linenumber AS pos, l_quantity / nullif(l_linenumber - 1, 0) AS guarded
       FROM lineitem""",
)
def arith_ops(t):
    quantity, number = F.col("l_quantity"), F.col("l_linenumber")
    return t.lineitem.select(
        "l_orderkey",
        (quantity + 1).alias("plus"),
        (quantity - 1).alias("minus"),
        (quantity * F.col("l_tax")).alias("times"),
        (F.col("l_extendedprice") / quantity).alias("over"),
        (number % 3).alias("rem"),
        F.negative(number).alias("neg"),
        F.positive(number).alias("pos"),
        F.try_divide(quantity, number - 1).alias("guarded"),
    )


@query(
    "int_div",
    """SELECT o_orderkey, o_orderkey // 7 AS sevenths, (0 - o_orderkey) // 7 AS negative_sevenths,
              o_custkey // nullif(o_orderkey % 3, 0) AS guarded FROM orders""",
)
def int_div(t):
    return t.orders.select(
        "o_orderkey",
        F.expr("o_orderkey div 7").alias("sevenths"),
        F.expr("-o_orderkey div 7").alias("negative_sevenths"),
        F.expr("o_custkey div nullif(o_orderkey % 3, 0)").alias("guarded"),
    )


@query(
    "bitwise_ops",
    """SELECT o_orderkey, o_orderkey & o_custkey AS both, o_orderkey | o_custkey AS either,
              xor(o_orderkey, o_custkey) AS one, ~o_orderkey AS flipped FROM orders""",
)
def bitwise_ops(t):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey",
        a.bitwiseAND(b).alias("both"),
        a.bitwiseOR(b).alias("either"),
        a.bitwiseXOR(b).alias("one"),
        F.bitwise_not(a).alias("flipped"),
    )


@query(
    "str_concat",
    """SELECT p_partkey, p_brand || '/' || p_name || ' ' || p_size AS label FROM part""",
)
def str_concat(t):
    return t.part.select(
        "p_partkey", F.concat("p_brand", F.lit("/"), "p_name", F.lit(" "), "p_size").alias("label")
    )


@query(
    "str_position",
    """SELECT doc_id, CAST(position('the' IN text) AS INTEGER) AS at FROM documents""",
)
def str_position(t):
    return t.documents.select("doc_id", F.position(F.lit("the"), F.col("text")).alias("at"))


@query(
    "str_trim",
    """SELECT p_partkey, trim(p_name, 'bdegr') AS both, ltrim(p_name, 'bdegr') AS lead,
              rtrim(p_name, 'bdegr') AS trail, trim('  ' || p_type || ' ') AS spaces FROM part""",
)
def str_trim(t):
    return t.part.select(
        "p_partkey",
        F.expr("trim(BOTH 'bdegr' FROM p_name)").alias("both"),
        F.expr("trim(LEADING 'bdegr' FROM p_name)").alias("lead"),
        F.expr("trim(TRAILING 'bdegr' FROM p_name)").alias("trail"),
        F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("spaces"),
    )


@query(
    "cast_types",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text, CAST(trunc(o_totalprice) AS BIGINT) AS whole,
              CASE WHEN o_custkey % 2 = 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END
                AS sometimes_a_number,
              CAST(substr(o_orderpriority, 1, 1) AS TINYINT) AS priority,
              CAST(o_custkey AS FLOAT) AS single, CAST(o_custkey % 2 AS BOOLEAN) AS odd,
              CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS exact,
              strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day
       FROM orders""",
)
def cast_types(t):
    priority = F.col("o_orderpriority")
    first_one_or_two = F.substring(priority, F.lit(1), (F.col("o_custkey") % 2 + 1).cast("int"))
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("text"),
        F.col("o_totalprice").cast("bigint").alias("whole"),
        casting.whole_number(first_one_or_two).alias("sometimes_a_number"),
        F.substring(priority, 1, 1).cast("tinyint").alias("priority"),
        F.col("o_custkey").cast("float").alias("single"),
        (F.col("o_custkey") % 2).cast("boolean").alias("odd"),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("exact"),
        F.col("o_orderdate").cast("date").cast("string").alias("day"),
    )


@query(
    "literals",
    """SELECT c_custkey, 1::TINYINT AS tiny, 2::SMALLINT AS small, 3 AS whole, 4::BIGINT AS big,
              1.5::DOUBLE AS dbl, 2.5::FLOAT AS single, 1.25::DECIMAL(3, 2)::VARCHAR AS exact, true AS yes,
              NULL IS NULL AS nothing_is_null, 'a' || 'b' AS joined, (DATE '2024-02-29')::VARCHAR AS day,
              (TIMESTAMP '2024-02-29 12:30:00')::VARCHAR AS moment, hex(unhex('cafe')) AS bytes
       FROM customer""",
)
def literals(t):
    return t.customer.select(
        "c_custkey",
        *[
            F.expr(text).alias(name)
            for name, text in {
                "tiny": "1Y",
                "small": "2S",
                "whole": "3",
                "big": "4L",
                "dbl": "1.5D",
                "single": "2.5F",
                "exact": "CAST(1.25BD AS STRING)",
                "yes": "true",
                "nothing_is_null": "NULL IS NULL",
                "joined": "'a' 'b'",
                "day": "CAST(DATE '2024-02-29' AS STRING)",
                "moment": "CAST(TIMESTAMP_NTZ '2024-02-29 12:30:00' AS STRING)",
                "bytes": "hex(X'cafe')",
            }.items()
        ],
    )


@query(
    "date_interval",
    """SELECT o_orderkey,
              strftime(o_orderdate + INTERVAL 3 DAY + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS due,
              strftime(o_orderdate + INTERVAL 14 MONTH, '%Y-%m-%d') AS renewal,
              strftime(o_orderdate - INTERVAL 1 YEAR, '%Y-%m-%d') AS year_ago,
              strftime(o_orderdate + to_days(CAST(o_custkey % 10 AS INTEGER)), '%Y-%m-%d') AS shifted
       FROM orders""",
)
def date_interval(t):
    placed, day = F.col("o_orderdate"), "yyyy-MM-dd"
    return t.orders.select(
        "o_orderkey",
        F.date_format(
            placed + F.expr("INTERVAL 3 DAYS") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss"
        ).alias("due"),
        F.date_format(placed + F.expr("INTERVAL '1-2' YEAR TO MONTH"), day).alias("renewal"),
        F.date_format(placed - F.make_ym_interval(F.lit(1), F.lit(0)), day).alias("year_ago"),
        F.date_format(
            placed + F.make_dt_interval((F.col("o_custkey") % 10).cast("int")), day
        ).alias("shifted"),
    )


@query(
    "struct_ops",
    """SELECT c_custkey, s.name AS name, s.place.nation AS nation, s.place.balance > 0 AS solvent
       FROM (SELECT c_custkey, {'name': c_name,
             'place': {'nation': c_nationkey, 'balance': c_acctbal}} AS s FROM customer)
       WHERE (c_custkey, s.place.nation) <> (1, 1)""",
)
def struct_ops(t):
    place = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    both = F.struct(F.col("c_name").alias("name"), place.alias("place"))
    shaped = t.customer.select("c_custkey", both.alias("s"))
    pair = F.struct("c_custkey", "s.place.nation")
    return shaped.filter(
        pair != F.struct(F.lit(1).cast("long"), F.lit(1))
    ).select(
        "c_custkey",
        F.col("s.name").alias("name"),
        F.col("s")["place"]["nation"].alias("nation"),
        (F.col("s.place").getField("balance") > 0).alias("solvent"),
    )


@query(
    "subscript",
    """SELECT vec_id, embedding[1] AS first, embedding[label % 7 + 1] AS picked,
              embedding[1000000] IS NULL AS past_end, label::VARCHAR AS by_key,
              (MAP {'label': label::VARCHAR})['other'] IS NULL AS no_key
       FROM embeddings""",
)
def subscript(t):
    vector = F.col("embedding")
    names = F.create_map(F.lit("label"), F.col("label").cast("string"))
    return t.embeddings.select(
        "vec_id",
        vector[0].alias("first"),
        vector[F.col("label") % 7].alias("picked"),
        F.get(vector, F.lit(999999)).isNull().alias("past_end"),
        names["label"].alias("by_key"),
        F.try_element_at(names, F.lit("other")).isNull().alias("no_key"),
    )


@query(
    "function_call",
    """SELECT event_id, concat_ws('-', upper(event_type), CAST(year(ts) AS VARCHAR),
                lpad(CAST(abs(user_id - 75) AS VARCHAR), 3, '0')) AS code,
              coalesce(nullif(event_type, 'error'), 'none') AS kind,
              greatest(user_id % 7, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5) AS top,
              CAST(len(list_distinct([user_id % 2, user_id % 3, 1])) AS INTEGER) AS kinds
       FROM events""",
)
def function_call(t):
    user = F.col("user_id")
    number = F.lpad(F.abs(user - 75).cast("string"), 3, "0")
    return t.events.select(
        "event_id",
        F.concat_ws("-", F.upper("event_type"), F.year("ts"), number).alias("code"),
        F.coalesce(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("kind"),
        F.greatest(user % 7, F.get_json_object("props", "$.k").cast("bigint") % 5).alias("top"),
        F.size(F.array_distinct(F.array(user % 2, user % 3, F.lit(1).cast("long")))).alias("kinds"),
    )


@query(
    "func_string",
    """SELECT p_partkey, upper(p_name) AS up, CAST(length(p_name) AS INTEGER) AS len,
              replace(p_name, 'ring', 'band') AS swapped, substr(p_brand, 7) AS number,
              lpad(p_size::VARCHAR, 4, '0') AS padded, reverse(p_type) AS backward,
              regexp_replace(p_name, '[aeiou]', '_', 'g') AS hidden, repeat('*', p_size % 4) AS stars,
              md5(p_name) AS digest, split_part(p_name, ' ', 2) AS noun
       FROM part""",
)
def func_string(t):
    return t.part.select(
        "p_partkey",
        F.upper("p_name").alias("up"),
        F.length("p_name").alias("len"),
        F.replace("p_name", F.lit("ring"), F.lit("band")).alias("swapped"),
        F.substr("p_brand", F.lit(7)).alias("number"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.reverse("p_type").alias("backward"),
        F.regexp_replace("p_name", "[aeiou]", "_").alias("hidden"),
        F.repeat(F.lit("*"), F.col("p_size") % 4).alias("stars"),
        F.md5("p_name").alias("digest"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"),
    )


@query(
    "func_date",
    """SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m,
              CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h,
              CAST(dayofweek(ts) + 1 AS INTEGER) AS weekday, CAST(quarter(ts) AS INTEGER) AS q,
              strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour_start,
              strftime(last_day(ts), '%Y-%m-%d') AS month_end,
              CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_number,
              CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds
       FROM events""",
)
def func_date(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        F.year(ts).alias("y"),
        F.month(ts).alias("m"),
        F.dayofmonth(ts).alias("d"),
        F.hour(ts).alias("h"),
        F.dayofweek(ts).alias("weekday"),
        F.quarter(ts).alias("q"),
        F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:mm:ss").alias("hour_start"),
        F.last_day(ts).cast("string").alias("month_end"),
        F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).alias("day_number"),
        F.unix_seconds(ts.cast("timestamp_ltz")).alias("seconds"),
    )


@query(
    "func_math",
    """SELECT c_custkey, abs(c_acctbal) AS size, CAST(ceil(c_acctbal) AS BIGINT) AS up,
              CAST(floor(c_acctbal) AS BIGINT) AS down, round(sqrt(abs(c_acctbal)), 6) AS root,
              round(ln(abs(c_acctbal) + 1), 6) AS log, CAST(sign(c_acctbal) AS INTEGER) AS sign,
              greatest(c_custkey, 50) AS at_least, least(c_custkey, 50) AS at_most,
              round(pow(c_nationkey, 2), 1) AS square
       FROM customer""",
)
def func_math(t):
    balance, key = F.col("c_acctbal"), F.col("c_custkey")
    return t.customer.select(
        key,
        F.abs(balance).alias("size"),
        F.ceil(balance).alias("up"),
        F.floor(balance).alias("down"),
        F.round(F.sqrt(F.abs(balance)), 6).alias("root"),
        F.round(F.ln(F.abs(balance) + 1), 6).alias("log"),
        F.signum(balance).cast("int").alias("sign"),
        F.greatest(key, F.lit(50)).alias("at_least"),
        F.least(key, F.lit(50)).alias("at_most"),
        F.round(F.pow("c_nationkey", F.lit(2)), 1).alias("square"),
    )


@query(
    "func_array",
    """SELECT doc_id, CAST(len(words) AS INTEGER) AS n, list_contains(words, 'the') AS has_the,
              CAST(len(list_distinct(words)) AS INTEGER) AS distinct_words, list_max(words) AS biggest,
              array_to_string(list_transform(words[1:5], lambda w: length(w)), ',') AS lengths,
              CAST(len(list_filter(words, lambda w: length(w) > 8)) AS INTEGER) AS long_words
       FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents)""",
)
def func_array(t):
    words = F.col("words")
    return t.documents.select("doc_id", F.split("text", " ", -1).alias("words")).select(
        "doc_id",
        F.size(words).alias("n"),
        F.array_contains(words, "the").alias("has_the"),
        F.size(F.array_distinct(words)).alias("distinct_words"),
        F.array_max(words).alias("biggest"),
        F.array_join(
            F.transform(F.slice(words, 1, 5), lambda w: F.length(w).cast("string")), ","
        ).alias("lengths"),
        F.size(F.filter(words, lambda w: F.length(w) > 8)).alias("long_words"),
    )


@query(
    "func_map",
    """SELECT event_id, m['kind'] AS kind, m['who'] AS who, CAST(cardinality(m) AS INTEGER) AS entries,
              map_contains(m, 'kind') AS has_kind, map_contains(m, 'other') AS has_other,
              array_to_string(list_sort(map_keys(m)), ',') AS keys
       FROM (SELECT event_id, MAP {'kind': event_type, 'who': user_id::VARCHAR} AS m FROM events)""",
)
def func_map(t):
    facts = F.create_map(
        F.lit("kind"), F.col("event_type"), F.lit("who"), F.col("user_id").cast("string")
    )
    m = F.col("m")
    return t.events.select("event_id", facts.alias("m")).select(
        "event_id",
        m["kind"].alias("kind"),
        F.element_at(m, "who").alias("who"),
        F.size(m).alias("entries"),
        F.map_contains_key(m, "kind").alias("has_kind"),
        F.map_contains_key(m, "other").alias("has_other"),
        F.array_join(F.array_sort(F.map_keys(m)), ",").alias("keys"),
    )


@query(
    "func_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              json_extract_string(props, '$.k') AS k_text, json_extract_string(props, '$.none') IS NULL AS missing,
              '{"k":' || json_extract_string(props, '$.k') || '}' AS compact
       FROM events""",
)
def func_json(t):
    parsed = F.from_json("props", "k int")
    return t.events.select(
        "event_id",
        parsed["k"].alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"),
        F.get_json_object("props", "$.none").isNull().alias("missing"),
        F.to_json(parsed).alias("compact"),
    )


@query(
    "udf_scalar",
    """SELECT doc_id, CAST(length(regexp_replace(text, '[^aeiouAEIOU]', '', 'g')) AS BIGINT) AS vowels
       FROM documents""",
)
def udf_scalar(t):
    return t.documents.select("doc_id", user_defined.vowel_count("text").alias("vowels"))


@query(
    "udf_scalar_pandas",
    """SELECT l_orderkey, l_linenumber,
              round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charged FROM lineitem""",
)
def udf_scalar_pandas(t):
    charged = user_defined.with_tax("l_extendedprice", "l_discount", "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(charged, 6).alias("charged"))


@query(
    "udaf_grouped",
    """SELECT l_returnflag, l_linestatus, round(exp(avg(ln(l_quantity))), 6) AS typical
       FROM lineitem WHERE l_quantity > 0 GROUP BY l_returnflag, l_linestatus""",
)
def udaf_grouped(t):
    keys = ["l_returnflag", "l_linestatus"]
    means = user_defined.geometric_mean(t.lineitem, keys, "l_quantity", "mean")
    return means.select(*keys, F.round("mean", 6).alias("typical"))


@query(
    "udtf_rows",
    """SELECT doc_id, CAST(pos - 1 AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n_chars
       FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
             FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))""",
)
def udtf_rows(t):
    t.spark.udtf.register("split_lines", user_defined.SplitLines)
    documents = t.view("documents", "millrace_documents")
    return t.spark.sql(
        f"""SELECT key AS doc_id, line_no, length(line) AS n_chars
            FROM split_lines(TABLE(SELECT doc_id, text FROM {documents}))"""
    )
