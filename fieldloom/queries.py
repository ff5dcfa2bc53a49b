"""The library's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import at_least_nonword, default_verb, escape_selector, filled, first_filled, first_known, model_prefix, split_items, whole_match, with_model_prefix
from .operators import invalid_rows, rule_report, valid_rows, with_violations
from .plans import column_of, compile_form, compile_forms
from .sources import read_table

EVEN_NAME = "Customer#[0-9]*[02468]"

#: A form over `customer`: its attributes as a page would carry them.
CUSTOMER_FORM = [
    {"name": "c_name", "data-val": "true", "data-val-required": "name?", "data-val-password": "weak", "data-val-password-nonalphamin": "1", "data-val-password-regex": EVEN_NAME},
    {"name": "c_mktsegment", "data-val": "true", "data-val-regex": "", "data-val-regex-pattern": "[A-G][A-Z]+", "data-val-length": "length", "data-val-length-min": "0", "data-val-length-max": "9"},
    {"name": "c_acctbal", "data-val": "true", "data-val-range": "range", "data-val-range-min": "0", "data-val-range-max": "5000"},
]


def regex_fullmatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    return df.select("c_custkey", "c_name", whole_match(F.col("c_name"), EVEN_NAME).alias("matches"), whole_match(F.col("c_name"), "Customer|Customer#[0-9]+").alias("leftmost"))


def nonalpha_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return df.select("doc_id", F.regexp_count("text", F.lit(r"\W")).alias("nonword"), at_least_nonword(F.col("text"), "300").alias("enough"))


def nonalpha_min_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    return df.select("p_partkey", at_least_nonword(F.col("p_name"), (F.col("p_partkey") % 3).cast("int")).alias("enough"))


def split_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return df.select("doc_id", F.posexplode(split_items(F.col("text"))).alias("pos", "item"))


def selector_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return df.select("page_id", escape_selector(F.col("url")).alias("escaped"))


def name_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    return df.select("page_id", model_prefix(F.col("url")).alias("prefix"))


def append_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    value = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("*."), "p_name")).otherwise(F.col("p_name"))
    return df.select("p_partkey", with_model_prefix(value, F.concat("p_brand", F.lit("."))).alias("full_name"))


def value_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    kind = F.col("event_id") % 3
    a = F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit("")).otherwise(F.col("event_type"))
    b = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.col("props"))
    return df.select("event_id", first_filled(a, b).alias("value"), default_verb(a).alias("verb"))


def request_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "events", ["event_id", "event_type", "props"])
    kind = F.col("event_id") % 3
    own = F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit("")).otherwise(F.col("event_type"))
    chosen = first_known(own, F.col("props"))
    return df.select("event_id", chosen.alias("request_id"), filled(chosen).alias("shown"))


def password_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    return df.select("c_custkey", (whole_match(F.col("c_name"), EVEN_NAME) & at_least_nonword(F.col("c_name"), "1")).alias("valid"))


def form_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    return with_violations(df, compile_form(CUSTOMER_FORM)).select("c_custkey", F.explode("violations").alias("v")).select("c_custkey", "v.field", "v.rule", "v.message")


def form_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_name", "c_mktsegment", "c_acctbal"])
    return rule_report(df, compile_form(CUSTOMER_FORM))


def form_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    return valid_rows(df, compile_form(CUSTOMER_FORM)).select("c_custkey")


def form_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    return invalid_rows(df, compile_form(CUSTOMER_FORM)).select("c_custkey")


#: A form over `part` and values made of it: bounds of lengths, and a field that must equal another.
PART_FORM = [
    {"name": "p_name", "data-val": "true", "data-val-minlength": "short", "data-val-minlength-min": "10", "data-val-maxlength": "long", "data-val-maxlength-max": "16"},
    {"name": "p.again", "data-val": "true", "data-val-equalto": "differs", "data-val-equalto-other": "*.type"},
    {"name": "outside", "form": "", "data-val": "true", "data-val-required": "in no form"},
]


def part_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    kind = F.col("p_partkey") % 4
    again = F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit("")).when(kind == 2, F.lower("p_brand")).otherwise(F.col("p_brand"))
    df = df.select("p_partkey", "p_name", F.col("p_brand").alias("p.type"), again.alias("p.again"))
    return with_violations(df, compile_form(PART_FORM)).select("p_partkey", F.explode("violations").alias("v")).select("p_partkey", "v.field", "v.rule", "v.message")


#: Rules without argument, over values of several tables as texts.
FLAGS = {"digits": "digits", "number": "number", "date": "date", "email": "email", "url": "url", "creditcard": "creditcard"}


def _flag_values(df: DataFrame) -> DataFrame:
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 5
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    card = F.concat(F.lit("4"), F.lpad(F.col("o_custkey").cast("string"), 14, "0"), (key % 10).cast("string"))
    return df.select(
        "o_orderkey",
        F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(key.cast("string"), F.lit(" "))).otherwise(key.cast("string")).alias("digits"),
        F.when(kind == 0, F.lit("-1.5e3")).when(kind == 1, F.lit("1,000")).when(kind == 2, F.lit(".5")).when(kind == 3, F.lit(".")).otherwise(key.cast("string")).alias("number"),
        F.when(kind == 0, F.concat(F.substring(day, 1, 8), F.lit("31"))).when(kind == 1, F.translate(day, "-", "/")).otherwise(day).alias("date"),
        F.when(kind == 0, F.concat(F.lit("c"), key.cast("string"), F.lit("@ex.org"))).when(kind == 1, F.lit("a@b@c.org")).when(kind == 2, F.lit("a b@c.org")).when(kind == 3, F.lit("a@localhost")).otherwise(F.lit("a.b@c.d.org")).alias("email"),
        F.when(kind == 0, F.concat(F.lit("HTTPS://ex.org/"), key.cast("string"))).when(kind == 1, F.lit("ftp://ex.org")).when(kind == 2, F.lit("http:///x")).when(kind == 3, F.lit("http://ex.org?q=1")).otherwise(F.lit("http://ex.org/a b")).alias("url"),
        F.when(kind == 0, F.concat(F.substring(card, 1, 4), F.lit("-"), F.substring(card, 5, 30))).when(kind == 1, F.substring(card, 1, 11)).otherwise(card).alias("creditcard"),
    )


def flag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _flag_values(read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]))
    form = compile_form([{"name": name, "data-val": "true", f"data-val-{rule}": ""} for name, rule in FLAGS.items()])
    return df.select("o_orderkey", *(column_of(name, rule, argument, True).alias(f"{name}_ok") for name, rules in form.rules.items() for rule, argument in rules.items() if rule != "__dummy__"))


def file_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    kind = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(kind == 0, F.lit(".PNG")).when(kind == 1, F.lit(".tar.gz")).when(kind == 2, F.lit("")).when(kind == 3, F.lit(".jpg/x")).otherwise(F.lit(".pngx")))
    media = F.when(kind == 0, F.lit("Image/png")).when(kind == 1, F.lit("text/plain")).when(kind == 2, F.lit("text/html")).when(kind == 3, F.lit("")).otherwise(F.lit("imagery/png"))
    form = compile_form([
        {"name": "file", "data-val": "true", "data-val-fileextensions": "", "data-val-fileextensions-extensions": "png, .gz|jpg"},
        {"name": "media", "data-val": "true", "data-val-accept": "", "data-val-accept-mimtype": "image/*, text/plain"},
    ])
    return valid_rows(df.select("p_partkey", name.alias("file"), media.alias("media")), form).select("p_partkey")


def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages by `url`, `extension` and `fileextensions`; the last rule always holds."""
    df = read_table(spark, sf_dir, "pages", ["page_id", "url"])
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    df = df.select("page_id", "url", path.alias("path"), F.replace("url", F.lit("://"), F.lit(":/")).alias("cut"))
    form = compile_form([
        {"name": "url", "data-val": "true", "data-val-url": ""},
        {"name": "path", "data-val": "true", "data-val-extension": "", "data-val-extension-extension": "html|pdf,.TXT"},
        {"name": "cut", "data-val": "true", "data-val-url": "", "data-val-fileextensions": "", "data-val-fileextensions-extensions": "org"},
    ])
    rules = [(name, rule, argument) for name, found in form.rules.items() for rule, argument in found.items() if rule != "__dummy__" or name == "url"]
    return df.select("page_id", *(column_of(name, rule, argument, True).alias(f"{name}_{rule.strip('_')}") for name, rule, argument in rules))


#: Rules that texts' words are held to.
WORD_RULES = ("email", "number", "digits", "url", "date", "creditcard")


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blank-separated words of each whole text keep each rule."""
    words = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.explode(F.split("text", r"[ \n]+")).alias("word"))
    form = compile_form([{"name": "word", "data-val": "true", **{f"data-val-{rule}": "" for rule in WORD_RULES}}])
    kept = [F.count_if((F.col("word") != "") & column_of("word", rule, form.rules["word"][rule], False)).alias(rule) for rule in WORD_RULES]
    return words.groupBy("doc_id").agg(F.count_if(F.col("word") != "").alias("words"), *kept)


#: Two forms of one page: a field belongs to the one it names.
ORDER_FORMS = [
    {"name": "o_totalprice", "form": "price", "data-val": "true", "data-val-range": "price", "data-val-range-min": "0x3E8", "data-val-range-max": "2.5e5"},
    {"name": "o_orderpriority", "form": "service", "data-val": "true", "data-val-regex": "urgency", "data-val-regex-pattern": "[1-3]-[A-Z ]+"},
    {"name": "o_orderstatus", "form": "service", "data-val": "true", "data-val-equalto": "odd", "data-val-equalto-other": "o_orderstatus", "data-val-maxlength": "", "data-val-maxlength-max": "1"},
    {"name": "o_custkey", "form": "", "data-val": "true", "data-val-digits": "in no form"},
]


def forms_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "orders", ["o_totalprice", "o_orderpriority", "o_orderstatus"])
    reports = [rule_report(df, form).withColumn("form", F.lit(name)) for name, form in compile_forms(ORDER_FORMS).items()]
    return reduce(DataFrame.unionByName, reports)


QUERIES = {
    f.__name__: f
    for f in (regex_fullmatch, nonalpha_min, nonalpha_min_by_row, split_trim, selector_escape, name_prefix, append_prefix, value_fallback, request_id, password_rule, form_violations, form_report, form_valid, form_invalid, part_violations, flag_rules, file_rules, page_rules, word_rules, forms_report)
}

_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_SIGNS = r"""[!"#$%&''()*+,./:;<=>?@\[\\\]^`{|}~]"""
BROKEN = f"""
  SELECT c_custkey, 'c_name' AS field, 'nonalphamin' AS rule, 'weak' AS message FROM customer WHERE len(regexp_extract_all(c_name, '[^A-Za-z0-9_]')) < 1
  UNION ALL SELECT c_custkey, 'c_name', 'regex', 'weak' FROM customer WHERE regexp_extract(c_name, '{EVEN_NAME}') <> c_name
  UNION ALL SELECT c_custkey, 'c_name', 'required', 'name?' FROM customer WHERE coalesce(c_name, '') = ''
  UNION ALL SELECT c_custkey, 'c_mktsegment', 'regex', '' FROM customer WHERE regexp_extract(c_mktsegment, '[A-G][A-Z]+') <> c_mktsegment
  UNION ALL SELECT c_custkey, 'c_mktsegment', 'rangelength', 'length' FROM customer WHERE length(c_mktsegment) NOT BETWEEN 0 AND 9
  UNION ALL SELECT c_custkey, 'c_acctbal', 'range', 'range' FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 5000"""

#: The rules without argument in DuckDB SQL, evaluated on a value.
_RULES = {
    "digits": "({0} = '' OR regexp_full_match({0}, '[0-9]+'))",
    "number": r"({0} = '' OR regexp_full_match({0}, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'))",
    "date": "({0} = '' OR (regexp_full_match({0}, '[0-9]+-[0-9]+-[0-9]+') AND length({0}) = 10 AND try_strptime({0}, '%Y-%m-%d') IS NOT NULL))",
    "email": r"({0} = '' OR regexp_full_match({0}, '[^\s@]+@[^\s@.]+(\.[^\s@.]+)+'))",
    "url": r"({0} = '' OR regexp_full_match({0}, '(?i:https?)://[^\s/?#]+([/?#]\S*)?'))",
    "creditcard": """({0} = '' OR (regexp_full_match(translate({0}, ' -', ''), '[0-9]+') AND length(translate({0}, ' -', '')) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse(translate({0}, ' -', '')), ''),
            lambda d, i: CASE WHEN i % 2 = 1 THEN try_cast(d AS INTEGER) ELSE (2 * try_cast(d AS INTEGER)) // 10 + (2 * try_cast(d AS INTEGER)) % 10 END)) % 10 = 0))""",
}

ORACLE_SQL = {
    "regex_fullmatch": f"SELECT c_custkey, c_name, regexp_extract(c_name, '{EVEN_NAME}') = c_name AS matches, regexp_extract(c_name, 'Customer|Customer#[0-9]+') = c_name AS leftmost FROM customer",
    "nonalpha_min": "SELECT doc_id, cast(len(regexp_extract_all(text, '[^A-Za-z0-9_]')) AS INTEGER) AS nonword, len(regexp_extract_all(text, '[^A-Za-z0-9_]')) >= 300 AS enough FROM documents",
    "nonalpha_min_by_row": "SELECT p_partkey, len(regexp_extract_all(p_name, '[^A-Za-z0-9_]')) >= greatest(p_partkey % 3, 1) AS enough FROM part",
    "split_trim": f"""WITH items AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}*,{_WS}*') AS a FROM documents)
        SELECT doc_id, cast(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS item FROM items""",
    "selector_escape": f"SELECT page_id, regexp_replace(url, '({_SIGNS})', '\\\\\\1', 'g') AS escaped FROM pages",
    "name_prefix": r"SELECT page_id, regexp_extract(url, '(?s)^.*\.') AS prefix FROM pages",
    "append_prefix": """WITH v AS (SELECT p_partkey, p_brand || '.' AS p, CASE WHEN p_partkey % 2 = 0 THEN '*.' || p_name ELSE p_name END AS v FROM part)
        SELECT p_partkey, CASE WHEN starts_with(v, '*.') THEN p || substr(v, 3) ELSE v END AS full_name FROM v""",
    "value_fallback": """WITH v AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS a, CASE WHEN event_id % 2 = 0 THEN '' ELSE props END AS b FROM events)
        SELECT event_id, coalesce(nullif(a, ''), nullif(b, ''), '') AS value, coalesce(nullif(a, ''), 'GET') AS verb FROM v""",
    "request_id": """WITH v AS (SELECT event_id, coalesce(CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END, props) AS r FROM events)
        SELECT event_id, r AS request_id, r IS NOT NULL AND r <> '' AS shown FROM v""",
    "password_rule": f"SELECT c_custkey, regexp_extract(c_name, '{EVEN_NAME}') = c_name AND len(regexp_extract_all(c_name, '[^A-Za-z0-9_]')) >= 1 AS valid FROM customer",
    "form_violations": BROKEN,
    "form_report": f"""WITH b AS ({BROKEN}), r(field, rule) AS (VALUES ('c_name', 'nonalphamin'), ('c_name', 'regex'), ('c_name', 'required'), ('c_mktsegment', 'regex'), ('c_mktsegment', 'rangelength'), ('c_acctbal', 'range'))
        SELECT field, rule, (SELECT count(*) FROM customer) AS checked, (SELECT count(*) FROM b WHERE b.field = r.field AND b.rule = r.rule) AS broken FROM r""",
    "form_valid": f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({BROKEN}))",
    "form_invalid": f"SELECT DISTINCT c_custkey FROM ({BROKEN})",
    "part_violations": """WITH v AS (SELECT p_partkey, p_name, p_brand, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN lower(p_brand) ELSE p_brand END AS again FROM part)
        SELECT p_partkey, 'p_name' AS field, 'minlength' AS rule, 'short' AS message FROM v WHERE length(p_name) BETWEEN 1 AND 9
        UNION ALL SELECT p_partkey, 'p_name', 'maxlength', 'long' FROM v WHERE length(p_name) > 16
        UNION ALL SELECT p_partkey, 'p.again', 'equalTo', 'differs' FROM v WHERE again <> '' AND again <> p_brand""",
    "flag_rules": rf"""WITH k AS (SELECT o_orderkey, o_orderkey % 5 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, '4' || lpad(cast(o_custkey AS VARCHAR), 14, '0') || cast(o_orderkey % 10 AS VARCHAR) AS card FROM orders),
        v AS (SELECT o_orderkey, CASE k WHEN 0 THEN '' WHEN 1 THEN o_orderkey || ' ' ELSE cast(o_orderkey AS VARCHAR) END AS digits,
            CASE k WHEN 0 THEN '-1.5e3' WHEN 1 THEN '1,000' WHEN 2 THEN '.5' WHEN 3 THEN '.' ELSE cast(o_orderkey AS VARCHAR) END AS number,
            CASE k WHEN 0 THEN 'c' || o_orderkey || '@ex.org' WHEN 1 THEN 'a@b@c.org' WHEN 2 THEN 'a b@c.org' WHEN 3 THEN 'a@localhost' ELSE 'a.b@c.d.org' END AS email,
            CASE k WHEN 0 THEN 'HTTPS://ex.org/' || o_orderkey WHEN 1 THEN 'ftp://ex.org' WHEN 2 THEN 'http:///x' WHEN 3 THEN 'http://ex.org?q=1' ELSE 'http://ex.org/a b' END AS url,
            CASE k WHEN 0 THEN day[1:8] || '31' WHEN 1 THEN translate(day, '-', '/') ELSE day END AS date, CASE k WHEN 0 THEN card[1:4] || '-' || card[5:] WHEN 1 THEN card[1:11] ELSE card END AS card FROM k)
        SELECT o_orderkey, {_RULES["digits"].format("digits")} AS digits_ok, {_RULES["number"].format("number")} AS number_ok, {_RULES["date"].format("date")} AS date_ok, {_RULES["email"].format("email")} AS email_ok,
            {_RULES["url"].format("url")} AS url_ok, {_RULES["creditcard"].format("card")} AS creditcard_ok FROM v""",
    "file_rules": r"""WITH v AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '.PNG' WHEN 1 THEN '.tar.gz' WHEN 2 THEN '' WHEN 3 THEN '.jpg/x' ELSE '.pngx' END AS file,
            CASE p_partkey % 5 WHEN 0 THEN 'Image/png' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/html' WHEN 3 THEN '' ELSE 'imagery/png' END AS media FROM part)
        SELECT p_partkey FROM v WHERE (file = '' OR regexp_matches(file, '(?i)\.(png|gz|jpg)$')) AND (media = '' OR regexp_full_match(media, '(?i)image/.*|text/plain'))""",
    "page_rules": rf"""WITH v AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, replace(url, '://', ':/') AS cut FROM pages)
        SELECT page_id, {_RULES["url"].format("url")} AS url_url, true AS url_dummy, path = '' OR regexp_matches(path, '(?i)\.(html|pdf|txt)$') AS path_extension, {_RULES["url"].format("cut")} AS cut_url,
            cut = '' OR regexp_matches(cut, '(?i)\.org$') AS cut_extension FROM v""",
    "word_rules": "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]+')) AS word FROM documents) SELECT doc_id, count(*) FILTER (word <> '') AS words, "
    + ", ".join(f"count(*) FILTER (word <> '' AND {_RULES[r].format('word')}) AS {r}" for r in ("email", "number", "digits", "url", "date", "creditcard"))
    + " FROM w GROUP BY doc_id",
    "forms_report": r"""SELECT 'price' AS form, 'o_totalprice' AS field, 'range' AS rule, count(*) AS checked, count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 250000) AS broken FROM orders
        UNION ALL SELECT 'service', 'o_orderpriority', 'regex', count(*), count(*) FILTER (NOT regexp_full_match(o_orderpriority, '[1-3]-[A-Z ]+')) FROM orders
        UNION ALL SELECT 'service', 'o_orderstatus', 'maxlength', count(*), count(*) FILTER (length(o_orderstatus) > 1) FROM orders
        UNION ALL SELECT 'service', 'o_orderstatus', 'equalTo', count(*), count(*) FILTER (o_orderstatus <> o_orderstatus) FROM orders""",
}
