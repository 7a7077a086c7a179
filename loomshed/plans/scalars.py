"""Scalar functions by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ngrams, strip_tags
from ..functions.vectors import compared
from ..sources.tables import table
from . import query


@query("""
    SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, length(p_name) AS len, substring(p_name, 2, 4) AS sub, concat_ws('-', p_brand, p_type) AS joined, replace(p_type, 'A', '_') AS repl, translate(p_brand, 'B#', 'b.') AS tr,
      trim('  ' || p_name || ' ') AS tri, reverse(p_name) AS rev, lpad(p_brand, 12, '*') AS pad, left(p_type, 3) AS lef, repeat(p_brand, 2) AS rep, split_part(p_brand, '#', 2) AS part, ascii(p_name) AS asc, levenshtein(p_name, p_type) AS dist, position('a' IN p_name) AS pos
    FROM part
""")
def scalar_strings(spark, d):
    b, n, t = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    long = lambda c: c.cast("bigint")
    return table(spark, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower(t).alias("low"), long(F.length(n)).alias("len"), F.substring(n, 2, 4).alias("sub"), F.concat_ws("-", b, t).alias("joined"), F.replace(t, F.lit("A"), F.lit("_")).alias("repl"), F.translate(b, "B#", "b.").alias("tr"),
        F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("tri"), F.reverse(n).alias("rev"), F.lpad(b, 12, "*").alias("pad"), F.left(t, F.lit(3)).alias("lef"), F.repeat(b, 2).alias("rep"), F.split_part(b, F.lit("#"), F.lit(2)).alias("part"),
        F.ascii(n).alias("asc"), long(F.levenshtein(n, t)).alias("dist"), long(F.locate("a", n)).alias("pos"),
    )


@query("""
    SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS plain, regexp_extract(url, '//([^/]+)', 1) AS host, len(regexp_extract_all(url, '[0-9]'))::BIGINT AS digits, len(string_split(url, '/'))::BIGINT AS parts FROM pages
""")
def scalar_regex(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_replace(u, "[0-9]+", "#").alias("plain"), F.regexp_extract(u, "//([^/]+)", 1).alias("host"), F.regexp_count(u, F.lit("[0-9]")).cast("bigint").alias("digits"), F.size(F.split(u, "/")).cast("bigint").alias("parts")
    )


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s, hex(source) AS h, base64(encode(source)) AS b FROM documents")
def scalar_digests(spark, d):
    t, s = F.col("text").cast("binary"), F.col("source")
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("m"), F.sha2(t, 256).alias("s"), F.hex(s).alias("h"), F.base64(s.cast("binary")).alias("b"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS chars FROM pages")
def scalar_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")).alias("host"), F.length(strip_tags("html")).cast("bigint").alias("chars"))


@query("""
    SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS dd, dayofyear(o_orderdate) AS doy, last_day(o_orderdate) AS last, datediff('day', DATE '1995-01-01', o_orderdate::DATE) AS days,
      weekofyear(o_orderdate) AS w, isodow(o_orderdate) AS iso, dayofweek(o_orderdate) AS dow, strftime(o_orderdate, '%Y/%m') AS ym, epoch(o_orderdate)::BIGINT AS sec, date_trunc('month', o_orderdate)::TIMESTAMP AS mon,
      (o_orderdate + INTERVAL 3 MONTH)::TIMESTAMP AS later, datesub('month', TIMESTAMP '1992-01-15', o_orderdate) AS months
    FROM orders
""")
def scalar_dates(spark, d):
    t = F.col("o_orderdate")
    whole = {"y": F.year(t), "q": F.quarter(t), "m": F.month(t), "dd": F.day(t), "doy": F.dayofyear(t), "days": F.datediff(t, F.lit("1995-01-01").cast("date")), "w": F.weekofyear(t), "iso": F.weekday(t) + 1, "dow": F.dayofweek(t) - 1}
    return table(spark, d, "orders").select(
        "o_orderkey", *(f.cast("bigint").alias(n) for n, f in whole.items()), F.last_day(t).alias("last"), F.date_format(t, "yyyy/MM").alias("ym"), F.unix_timestamp(t.cast("timestamp")).alias("sec"), F.date_trunc("month", t).cast("timestamp_ntz").alias("mon"),
        (t + F.expr("INTERVAL '3' MONTH")).alias("later"), F.expr("timestampdiff(MONTH, TIMESTAMP_NTZ '1992-01-15', o_orderdate)").alias("months"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice, 1) AS r, abs(l_discount - 0.05) AS a, round(sqrt(l_quantity), 9) AS s, round(cbrt(l_quantity), 9) AS c, round(ln(l_extendedprice), 9) AS l, round(log10(l_extendedprice), 9) AS lg,
      round(exp(l_tax), 9) AS e, round(sin(l_quantity), 9) AS si, round(atan2(l_tax, l_discount + 1), 9) AS at, round(power(l_quantity, 1.5), 6) AS p, l_orderkey % 7 AS m, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le,
      floor(l_quantity / 7)::DOUBLE AS fl, ceil(l_quantity / 7)::DOUBLE AS ce, sign(l_discount - 0.05)::DOUBLE AS sg, l_orderkey // 3 AS dv, (l_orderkey & 12) AS ba, (l_orderkey | 3) AS bo, xor(l_orderkey, 5) AS bx
    FROM lineitem
""")
def scalar_math(spark, d):
    q, e, t, di, k = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount"), F.col("l_orderkey")
    nine = {"s": F.sqrt(q), "c": F.cbrt(q), "l": F.ln(e), "lg": F.log10(e), "e": F.exp(t), "si": F.sin(q), "at": F.atan2(t, di + 1)}
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.round(e, 1).alias("r"), F.abs(di - 0.05).alias("a"), *(F.round(f, 9).alias(n) for n, f in nine.items()), F.round(F.pow(q, F.lit(1.5)), 6).alias("p"), (k % 7).alias("m"), F.greatest(t, di).alias("g"), F.least(t, di).alias("le"),
        F.floor(q / 7).cast("double").alias("fl"), F.ceil(q / 7).cast("double").alias("ce"), F.sign(di - 0.05).alias("sg"), F.expr("l_orderkey div 3").alias("dv"), k.bitwiseAND(12).alias("ba"), k.bitwiseOR(3).alias("bo"), k.bitwiseXOR(5).alias("bx"),
    )


@query("""
    SELECT vec_id, len(embedding)::BIGINT AS n, list_max(embedding) AS high, embedding[1] AS head, round(list_sum(list_transform(embedding[1:4], lambda x: x::DOUBLE)), 6) AS s,
      len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, list_contains(list_transform(embedding, lambda x: x > 0.5), true) AS some FROM embeddings
""")
def scalar_arrays(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", F.size(e).cast("bigint").alias("n"), F.array_max(e).alias("high"), F.element_at(e, 1).alias("head"), F.round(F.aggregate(F.slice(e, 1, 4), F.lit(0.0), lambda s, x: s + x), 6).alias("s"),
        F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"), F.exists(e, lambda x: x > 0.5).alias("some"),
    )


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0)
    SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS cos, round(list_inner_product(embedding::DOUBLE[], e::DOUBLE[]), 6) AS dot, round(list_distance(embedding::DOUBLE[], e::DOUBLE[]), 6) AS dist FROM embeddings, q
""")
def scalar_vectors(spark, d):
    """Each fiftieth vector as a query against all of them, in blocks."""
    e = table(spark, d, "embeddings")
    return compared(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "query_id")


@query("""
    SELECT k, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat([1, 2, 2, n_regionkey], [n_nationkey % 3]))) AS k FROM nation) GROUP BY k
""")
def scalar_array_sets(spark, d):
    a = F.array_distinct(F.concat(F.array(F.lit(1), F.lit(2), F.lit(2), "n_regionkey"), F.array(F.col("n_nationkey") % 3)))
    return table(spark, d, "nation").select(F.explode(a).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("""
    SELECT doc_id, len(list_distinct(list_concat(list_distinct(a), b))) AS n_union, len(list_intersect(a, b)) AS n_both, len(list_filter(a, lambda w: len(w) > 60)) = 0 AS short
    FROM (SELECT doc_id, w[1:len(w) // 2] AS a, w[len(w) // 2 + 1:] AS b FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
""")
def scalar_word_sets(spark, d):
    """Set functions on the words of a text's first and second half."""
    t = table(spark, d, "documents").select("doc_id", F.split("text", " ").alias("w")).withColumn("half", F.floor(F.size("w") / 2).cast("int"))
    t = t.select("doc_id", F.slice("w", F.lit(1), F.col("half")).alias("a"), F.slice("w", F.col("half") + 1, F.size("w") - F.col("half")).alias("b"))
    return t.select("doc_id", F.size(F.array_union("a", "b")).cast("bigint").alias("n_union"), F.size(F.array_intersect("a", "b")).cast("bigint").alias("n_both"), F.forall("a", lambda w: F.length(w) <= 60).alias("short"))


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 3 MONTH)::TIMESTAMP AS later, list_sort(map_keys(MAP {'s' || o_orderstatus: 1, 'p': 2})) AS keys FROM orders")
def scalar_months_and_keys(spark, d):
    later = F.add_months(F.col("o_orderdate").cast("date"), 3).cast("timestamp_ntz")
    return table(spark, d, "orders").select("o_orderkey", later.alias("later"), F.sort_array(F.map_keys(F.create_map(F.concat(F.lit("s"), "o_orderstatus"), F.lit(1), F.lit("p"), F.lit(2)))).alias("keys"))


@query("SELECT n_name, pos, letter FROM (SELECT n_name, unnest(range(0, len(n_name))) AS pos, unnest(string_split(n_name, '')) AS letter FROM nation)")
def scalar_posexplode(spark, d):
    return table(spark, d, "nation").select("n_name", F.posexplode(F.split("n_name", "")).alias("pos", "letter")).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k') AS by_schema, json_extract_string(props, '$.k') AS by_variant, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS n FROM events")
def scalar_json(spark, d):
    """Three readers of JSON, each as it reads: by a path, a schema, a variant."""
    p = F.col("props")
    e = table(spark, d, "events").select("event_id", F.get_json_object(p, "$.k").alias("k"), F.from_json(p, "k string").k.alias("by_schema"), F.try_variant_get(F.parse_json(p), "$.k", "string").alias("by_variant"))
    return e.withColumn("n", F.col("k").try_cast("bigint"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'u' ELSE 'o' END AS kind, n FROM (SELECT conv_id, turn, role, length(text) AS n FROM conversations)")
def scalar_maps_structs(spark, d):
    kinds = F.create_map(F.lit("user"), F.lit("u"))
    s = F.struct(F.coalesce(kinds[F.col("role")], F.lit("o")).alias("kind"), F.length("text").cast("bigint").alias("n"))
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.kind", "s.n")


@query("SELECT item_id, len(list_distinct(list_transform(range(1, length(text) - 2), lambda i: substring(text, i, 4))))::BIGINT AS grams FROM benchmark WHERE length(text) >= 4")
def scalar_ngrams(spark, d):
    return table(spark, d, "benchmark").where(F.length("text") >= 4).select("item_id", F.size(ngrams("text", 4)).cast("bigint").alias("grams"))


@query("SELECT o_orderkey, (o_totalprice / nullif(o_orderkey % 3, 0)) IS NULL AS none, o_orderkey IS NOT NULL AS some FROM orders")
def scalar_try(spark, d):
    """Division by zero gives null where it would stop a strict session."""
    return table(spark, d, "orders").select("o_orderkey", F.try_divide("o_totalprice", F.col("o_orderkey") % 3).isNull().alias("none"), F.col("o_orderkey").isNotNull().alias("some"))


@query("""
    SELECT event_id, hour(ts) AS h, minute(ts) AS m, floor(second(ts))::BIGINT AS s, make_date(year(ts), month(ts), 1) AS first, (ts - INTERVAL 90 MINUTE)::TIMESTAMP AS before, ts > TIMESTAMP '2024-01-15 12:00:00' AS late FROM events
""")
def scalar_times(spark, d):
    t = F.col("ts")
    return table(spark, d, "events").select(
        "event_id", F.hour(t).cast("bigint").alias("h"), F.minute(t).cast("bigint").alias("m"), F.second(t).cast("bigint").alias("s"), F.make_date(F.year(t), F.month(t), F.lit(1)).alias("first"), (t - F.expr("INTERVAL '90' MINUTE")).alias("before"), (t > F.expr("TIMESTAMP_NTZ '2024-01-15 12:00:00'")).alias("late")
    )


@query("""
    SELECT n_name, round_even(n_nationkey / 2.0, 0)::DOUBLE AS even, round(radians(n_nationkey), 9) AS rad, n_nationkey << 3 AS shifted, bit_count(n_nationkey)::BIGINT AS bits, upper(n_name[1]) || lower(n_name[2:]) AS cap FROM nation
""")
def scalar_more_math(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_name", F.bround(k / 2.0, 0).alias("even"), F.round(F.radians(k), 9).alias("rad"), F.shiftleft(k, 3).alias("shifted"), F.bit_count(k).cast("bigint").alias("bits"), F.initcap(F.lower("n_name")).alias("cap"))


@query("""
    SELECT n_regionkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, list_contains(a, 3) AS has, list_position(a, 7)::BIGINT AS at, len(flatten([a, b]))::BIGINT AS n, list_aggregate(list_transform(list_zip(a, b), lambda z: z[1] * z[2]), 'sum')::BIGINT AS dot
    FROM (SELECT n_regionkey, [1, 3, 7, n_regionkey] AS a, [3, n_regionkey, 9, 1] AS b FROM nation)
""")
def scalar_more_arrays(spark, d):
    a, b = (F.array(*(F.lit(x) if isinstance(x, int) else F.col(x) for x in xs)) for xs in ((1, 3, 7, "n_regionkey"), (3, "n_regionkey", 9, 1)))
    text = F.array_join(F.transform(F.array_sort(F.array_intersect(a, b)), lambda x: x.cast("string")), ",")
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return table(spark, d, "nation").select("n_regionkey", text.alias("both"), F.array_contains(a, 3).alias("has"), F.array_position(a, 7).alias("at"), F.size(F.flatten(F.array(a, b))).cast("bigint").alias("n"), dot.alias("dot"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), 'none') AS q, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM pages")
def scalar_urls(spark, d):
    part = lambda p, other: F.coalesce(F.nullif(F.try_parse_url(F.col("url"), F.lit(p)), F.lit("")), F.lit(other))
    return table(spark, d, "pages").select("page_id", part("QUERY", "none").alias("q"), part("PATH", "/").alias("path"))


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def scalar_map_entries(spark, d):
    """JSON as a map, its entries as rows."""
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value")).where(F.col("value").isNotNull())
