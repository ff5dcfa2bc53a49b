"""Hierarchical empirical Bayes: text evidence with host and path posteriors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ._common import discard, joined, written

#: Evidence features: name -> (Spark SQL, DuckDB SQL), whole numbers; {t} is the text, {n} its
#: characters, {w} its blank-separated words. Their bin is the bit length, at most BINS.
FEATURES = {
    "symbols": ("1000L * regexp_count({t}, '[#$%&*!|]') div greatest({n}, 1)", "1000 * len(regexp_extract_all({t}, '[#$%&*!|]')) // greatest({n}, 1)"),
    "capitals": ("1000L * regexp_count({t}, '[A-Z]') div greatest({n}, 1)", "1000 * len(regexp_extract_all({t}, '[A-Z]')) // greatest({n}, 1)"),
    "digits": ("1000L * regexp_count({t}, '[0-9]') div greatest({n}, 1)", "1000 * len(regexp_extract_all({t}, '[0-9]')) // greatest({n}, 1)"),
    "repeats": ("1000L * (size({w}) - size(array_distinct({w}))) div size({w})", "1000 * (len({w}) - len(list_distinct({w}))) // len({w})"),
    "stutter": ("1000L * size(filter({w}, (x, i) -> i > 0 and x = {w}[i - 1])) div size({w})", "1000 * len(list_filter({w}, lambda x, i: i > 1 AND x = {w}[i - 1])) // len({w})"),
    "word_length": ("cast(power(2, least({n} div size({w}), 14)) as bigint)", "cast(power(2, least({n} // len({w}), 14)) as bigint)"),
    "words": ("cast(size({w}) as bigint)", "cast(len({w}) as bigint)"),
}
BINS = 16


def _bin(sql: str) -> str:
    return f"cast(least(length(bin({sql})), {BINS}) as int)"


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column __fl_bins of the binned features."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = docs.withColumn("__fl", F.struct(text.alias("t"), F.char_length(text).cast("long").alias("n"), F.split(text, " ").alias("w")))
    fields = [F.expr(_bin(sql.format(t="__fl.t", n="__fl.n", w="__fl.w"))).alias(name) for name, (sql, _) in FEATURES.items()]
    return made.withColumn("__fl_bins", F.struct(*fields)).drop("__fl")


class Evidence:
    """Naive Bayes log-likelihood ratios of the binned features (BINS numbers a feature), and the labels' prior."""

    def __init__(self, good: int, bad: int, ratios: dict[str, dict[int, float]]):
        self.good, self.bad, self.ratios = good, bad, ratios
        self.prior = (good + 1) / (good + bad + 2)
        self.unseen = math.log(1 / (good + BINS)) - math.log(1 / (bad + BINS))

    @classmethod
    def fit(cls, bins: DataFrame, labels: DataFrame) -> "Evidence":
        """bins: doc_id and __fl_bins; labels: doc_id, quality. Counted over all labelled documents."""
        known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good"))
        rows = bins.join(known, "doc_id").select("good", F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"__fl_bins.{f}").alias("b")) for f in FEATURES))).alias("x"))
        counts = {(r["good"], r["f"], r["b"]): r["count"] for r in rows.groupBy("good", "x.f", "x.b").count().collect()}
        size = [sum(n for (g, f, _), n in counts.items() if g == kind and f == next(iter(FEATURES))) for kind in (False, True)]
        ratios = {f: {b: math.log((counts.get((True, f, b), 0) + 1) / (size[1] + BINS)) - math.log((counts.get((False, f, b), 0) + 1) / (size[0] + BINS)) for b in range(1, BINS + 1)} for f in FEATURES}
        return cls(size[1], size[0], ratios)

    def ratio(self) -> Column:
        total = F.lit(0.0)
        for f in FEATURES:
            total = total + F.element_at(F.array(*(F.lit(self.ratios[f][b]) for b in range(1, BINS + 1))), F.col(f"__fl_bins.{f}"))
        return total

    def posterior(self, ratio: Column) -> Column:
        return 1 / (1 + F.exp(-(ratio + math.log(self.prior / (1 - self.prior)))))


def strength(mean: float, n: float, groups: float, spread: float) -> float:
    """Pseudo-documents of the prior, by moments: spread is the weighted square deviation of group rates."""
    within = mean * (1 - mean)
    between = spread - within * groups / n if n else 0.0
    return min(max(within / between - 1, 1.0), 1e6) if between > 1e-9 else 1e6


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, n, host_rate, path_rate) from (host, path, p), written: sums by path, then by host, then over all.

    A host's rate is shrunk toward the rate of all, a path's toward its host's, by strengths found
    from the groups themselves: the fewer documents, the nearer the parent. n: the path's documents.

    Rows are one document each, repeated ones count each. host and path are never null (site_columns);
    a null p adds nothing but counts. An empty table gives no rows. Other columns aren't read.
    """
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    n, s, groups = hosts.agg(F.sum("hn"), F.sum("hs"), F.count("*")).first()
    if not n:
        return paths.select("host", "path", "n", F.lit(0.5).alias("host_rate"), F.lit(0.5).alias("path_rate"))
    mean = s / n
    spread = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - mean, 2)) / n).first()[0]
    k = strength(mean, n, groups, spread)
    hosts = hosts.withColumn("host_rate", (F.col("hs") + k * mean) / (F.col("hn") + k))
    rated = paths.join(hosts.select("host", "host_rate"), "host")
    groups, spread = rated.agg(F.count("*"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_rate"), 2)) / n).first()
    k = strength(mean, n, groups, spread)
    out = written(rated.select("host", "path", "n", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), "sites")
    discard(paths)
    return out


def site_columns(docs: DataFrame, site_col: str, path_col: str) -> tuple[Column, Column]:
    """Host and path. A site with `//` is an address; any other value is the host's name as it stands."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(""))
    rest = F.regexp_extract(site, r"//(?:[^/@]*@)?([^/:?#]*)", 1)
    host = F.when(site.contains("//"), F.lower(rest)).otherwise(site)
    path = F.when(site.contains("//"), F.regexp_extract(site, r"//[^/]*(/[^/?#]*)", 1)).otherwise(F.coalesce(F.col(path_col).cast("string"), F.lit("")))
    return host, path


def _rated(df: DataFrame, site_table: DataFrame) -> DataFrame:
    """df (__fl_host, __fl_path) with its site's rates; sites of many rows are broadcast, however many sites there are."""
    named = site_table.select(F.col("host").alias("__fl_host"), F.col("path").alias("__fl_path"), F.col("n").alias("__fl_n"), F.col("host_rate").alias("__fl_host_rate"), F.col("path_rate").alias("__fl_path_rate"))
    return joined(df, named, ["__fl_host", "__fl_path"], "__fl_n")


def _fitted(docs: DataFrame, labels: DataFrame, site_col: str, path_col: str, id_col: str, text_col: str):
    host, path = site_columns(docs, site_col, path_col)
    bins = written(with_features(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), host.alias("__fl_host"), path.alias("__fl_path"))).drop("text"), "bins")
    evidence = Evidence.fit(bins, labels)
    found = sites(bins.select(F.col("__fl_host").alias("host"), F.col("__fl_path").alias("path"), evidence.posterior(evidence.ratio()).alias("p")))
    return bins, evidence, found


def _scored(df: DataFrame, evidence: Evidence, site_table: DataFrame) -> DataFrame:
    """The ratio is found before the join: a filter by score cannot be pushed below that and inline the features."""
    rate = F.col("__fl_path_rate")
    return _rated(df.withColumn("__fl_ratio", evidence.ratio()), site_table).withColumn("__fl_score", 1 / (1 + F.exp(-(F.col("__fl_ratio") + F.log(rate / (1 - rate))))))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.2, site_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, host, path, evidence, host_rate, path_rate, score, keep) of every row.

    Evidence is a naive Bayes ratio over text features, counted from all labelled documents. Each
    document's posterior under the labels' prior is summed by path and host (partial sums before any
    shuffle, so a hot host is no hot task); the rates, shrunk up the hierarchy, replace the prior:
    score = sigmoid(logit(path_rate) + evidence); keep: score >= threshold.

    Null text: empty, scored like it. Null site or path: the one named ''. Null ids are scored and
    take no label; repeated rows are scored each; several labels of an id: their mean. Without any
    label the evidence is 0 and all rows are kept at 0.5. An empty table gives no rows.
    """
    bins, evidence, site_table = _fitted(docs, labels, site_col, path_col, id_col, text_col)
    return _scored(bins, evidence, site_table).select(
        "doc_id", F.col("__fl_host").alias("host"), F.col("__fl_path").alias("path"), F.round("__fl_ratio", 6).alias("evidence"),
        F.round("__fl_host_rate", 6).alias("host_rate"), F.round("__fl_path_rate", 6).alias("path_rate"), F.round("__fl_score", 6).alias("score"), (F.col("__fl_score") >= threshold).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.2, site_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, that quality() keeps.

    Texts are read again; those of sites with over 1/1024 of all rows aren't shuffled, others once.

    Nulls, repeated rows, missing labels and empty tables: as quality() has them; null ids stay if they score.
    """
    bins, evidence, site_table = _fitted(docs, labels, site_col, path_col, id_col, text_col)
    discard(bins)
    host, path = site_columns(docs, site_col, path_col)
    made = with_features(docs.withColumn("__fl_host", host).withColumn("__fl_path", path), text_col)
    return _scored(made, evidence, site_table).where(F.col("__fl_score") >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(threshold: float = 0.2) -> str:
    """DuckDB SQL of quality() over documents and labels."""
    names = list(FEATURES)
    bins = ", ".join(f"{_bin(sql.format(t='t', n='n', w='w'))} AS {f}" for f, (_, sql) in FEATURES.items())
    unpivot = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS f, {f} AS b FROM bins" for f in names)
    ratio = " + ".join(f"(SELECT coalesce(max(r), (SELECT ln(1 / (g + {BINS}.0)) - ln(1 / (b + {BINS}.0)) FROM size)) FROM ratios WHERE f = '{f}' AND ratios.b = bins.{f})" for f in names)
    return f"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(lang, '') AS path, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, length(t) AS n, string_split(t, ' ') AS w FROM base),
bins AS (SELECT doc_id, host, path, {bins} FROM words),
known AS (SELECT doc_id, avg(quality) >= 0.5 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
long AS ({unpivot}),
size AS (SELECT count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE NOT good) AS b FROM bins JOIN known USING (doc_id)),
ratios AS (SELECT f, long.b AS b, ln((count(*) FILTER (WHERE good) + 1) / (any_value(size.g) + {BINS}.0)) - ln((count(*) FILTER (WHERE NOT good) + 1) / (any_value(size.b) + {BINS}.0)) AS r
  FROM long JOIN known USING (doc_id), size GROUP BY f, long.b),
scored AS (SELECT *, {ratio} AS ratio FROM bins),
prior AS (SELECT ln(((g + 1) / (g + b + 2.0)) / (1 - (g + 1) / (g + b + 2.0))) AS l FROM size),
post AS (SELECT *, 1 / (1 + exp(-(ratio + l))) AS p FROM scored, prior),
paths AS (SELECT host, path, count(*) AS n, sum(p) AS s FROM post GROUP BY host, path),
hosts AS (SELECT host, sum(n) AS hn, sum(s) AS hs FROM paths GROUP BY host),
total AS (SELECT sum(hn) AS n, sum(hs) AS s, count(*) AS h, sum(hs) / sum(hn) AS m FROM hosts),
between_hosts AS (SELECT sum(hn * power(hs / hn - m, 2)) / any_value(total.n) - any_value(m * (1 - m) * h / total.n) AS v FROM hosts, total),
k1 AS (SELECT CASE WHEN v > 1e-9 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM between_hosts, total),
host_rates AS (SELECT host, (hs + k * m) / (hn + k) AS host_rate FROM hosts, total, k1),
joined AS (SELECT paths.*, host_rate FROM paths JOIN host_rates USING (host)),
between_paths AS (SELECT sum(joined.n * power(joined.s / joined.n - host_rate, 2)) / any_value(total.n) - any_value(m * (1 - m)) * count(*) / any_value(total.n) AS v FROM joined, total),
k2 AS (SELECT CASE WHEN v > 1e-9 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS k FROM between_paths, total),
rates AS (SELECT host, path, host_rate, (s + k * host_rate) / (n + k) AS path_rate FROM joined, k2)
SELECT doc_id, host, path, round(ratio, 6) AS evidence, round(host_rate, 6) AS host_rate, round(path_rate, 6) AS path_rate,
  round(1 / (1 + exp(-(ratio + ln(path_rate / (1 - path_rate))))), 6) AS score, 1 / (1 + exp(-(ratio + ln(path_rate / (1 - path_rate))))) >= {threshold} AS keep
FROM post JOIN rates USING (host, path)"""
