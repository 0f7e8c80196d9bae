"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the beginning of a path; it fits the host, its
subdomains and all paths that begin so, and the longest rule that fits decides.
URLs that a rule fits are the labelled ones.  From a bounded sample of them
boosted trees learn what the others are by the look of the URL: lengths, depth,
digits, entropy, parameters, and how often URLs of one host or file suffix are
labelled at all, and blocked.

All of it is expressions, joins and Spark's own trees; there is no Python
worker.  Counts of suffixes cover all URLs and labels that take part in the
fit; one in five labelled URLs takes no part, so that the trees can be judged.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from veilwork.llm.common import BROADCAST_BYTES, cut, width
from veilwork.operators.skew import salted_join

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs of each verdict that the trees are fitted on, by a hash of the URL.
MAX_ROWS = 10_000
#: One labelled URL in so many is held out.
FOLDS = 5
TREES, DEPTH, STEP = 20, 4, 0.2
#: Labelled URLs that a suffix is assumed to have besides its own, at the mean rate.
PRIOR = 4.0
#: Host suffixes of one to three labels, and the suffix of the file.
SUFFIXES = ("suffix_1", "suffix_2", "suffix_3", "suffix_file")
LEXICAL = (
    "url_length", "host_length", "path_length", "query_length", "labels", "depth", "hyphens",
    "digit_ratio", "entropy", "host_entropy", "parameters",
)


def parts(url: str) -> dict[str, Column]:
    """Host, path and query of a URL column; all empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return {
        "host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def _entropy(text: str) -> str:
    """Bits per character; 0 for an empty text."""
    share = f"((length({text}) - length(replace({text}, c, ''))) / length({text}))"
    letters = f"filter(array_distinct(split({text}, '')), c -> c <> '')"
    return f"aggregate({letters}, 0D, (e, c) -> e - {share} * log2({share}))"


def _last_labels(n: int) -> Column:
    """The host's last ``n`` labels; null where it has fewer."""
    return F.when(F.col("labels") >= n, F.substring_index("host", ".", -n))


def fitting_rule(rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits ``host`` and ``path``, or null.

    ``rules`` are pairs like ``("example.com/en/", "block")``.  They are a
    parameter, held in the expression by their hosts; a URL looks up its own
    host and the hosts above it.  Of two rules of one length that of the longer
    host wins.
    """
    hosts: dict[str, list] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        if not slash or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {rule} {verdict}")
        hosts.setdefault(host.lower(), []).append((rule, slash + path, verdict))
    if not hosts:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entries = [
        x for host, found in hosts.items()
        for x in (F.lit(host), F.array(*[
            F.struct(F.lit(len(r)).alias("size"), F.lit(len(host)).alias("host_size"), F.lit(r).alias("rule"),
                     F.lit(p).alias("path"), F.lit(v).alias("verdict"))
            for r, p, v in found
        ]))
    ]
    known = F.create_map(*entries)
    most = max(h.count(".") for h in hosts) + 1  # no rule has more labels
    above = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in range(1, most + 1)]))
    met = F.flatten(F.filter(F.transform(above, lambda h: F.try_element_at(known, h)), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(met, lambda x: F.startswith(F.col("path"), x["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def described(pages: DataFrame, rules: list[tuple[str, str]], key: str, url: str) -> DataFrame:
    """key, host, path, rule, verdict, fold, spread, u (a hash of the URL), the lexical features
    and the suffixes; nothing of it is null but key, rule, verdict and suffixes."""
    at = pages.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"))
    split = at.select("*", *[c.alias(n) for n, c in parts("url").items()])
    file = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    measured = split.select(
        "*",
        F.length("url").cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"), F.length("query").cast("double").alias("query_length"),
        F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).alias("labels"),
        F.size(F.array_remove(F.split("path", "/"), "")).cast("double").alias("depth"),
        (F.length("host") - F.length(F.replace("host", F.lit("-")))).cast("double").alias("hyphens"),
        F.expr("length(regexp_replace(url, '[^0-9]', '')) / greatest(length(url), 1)").alias("digit_ratio"),
        F.expr(_entropy("url")).alias("entropy"), F.expr(_entropy("host")).alias("host_entropy"),
        F.size(F.array_remove(F.split("query", "&"), "")).cast("double").alias("parameters"),
        F.xxhash64("url").alias("u"), F.xxhash64("key", "url").alias("spread"),
    )
    ruled = measured.select(
        "*", F.explode(F.array(fitting_rule(rules))).alias("fit"),
        *[_last_labels(n).alias(f"suffix_{n}") for n in (1, 2, 3)],
        F.when(file != "", F.lower(file)).alias("suffix_file"),
    )
    return ruled.select(
        "key", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"),
        F.pmod("u", F.lit(FOLDS)).alias("fold"), "spread", "u",
        *[F.col(n).cast("double").alias(n) for n in LEXICAL], *SUFFIXES,
    )


def _label() -> Column:
    """1 for a URL that takes part in the fit and is blocked, 0 for allowed, else null."""
    return F.when(F.col("rule").isNotNull() & (F.col("fold") > 0), (F.col("verdict") == BLOCK).cast("int"))


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """(kind, suffix, n_urls, n_labels, n_blocked) over all URLs; the last two by fold."""
    each = F.explode(F.array(*[
        F.struct(F.lit(s).alias("kind"), F.col(s).alias("suffix")) for s in SUFFIXES
    ]))
    rows = urls.select(each.alias("s"), _label().alias("y"), "fold").where("s.suffix IS NOT NULL")
    of = lambda f, test: F.count_if((F.col("fold") == f) & test)
    return rows.groupBy("s.kind", "s.suffix").agg(
        F.count("*").alias("n_urls"),
        F.array(*[of(f, F.col("y").isNotNull()) for f in range(FOLDS)]).alias("n_labels"),
        F.array(*[of(f, F.col("y") == 1) for f in range(FOLDS)]).alias("n_blocked"),
    )


def _with_statistics(rows: DataFrame, statistics: DataFrame, mean: float, fit: bool) -> DataFrame:
    """Two features for each suffix.  For the fit, a row's own fold is left out of the rate:
    its own label would else be told by it."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    seen = lambda c: total(c) - F.get(F.col(c), F.col("fold")) if fit else total(c)
    for s in SUFFIXES:
        of = statistics.where(F.col("kind") == s).select(F.col("suffix").alias(s), "n_urls", "n_labels", "n_blocked")
        small = width(of) <= BROADCAST_BYTES
        met = rows.join(F.broadcast(of), s, "left") if small else salted_join(rows, of, s, spread_by="spread")
        rate = (F.coalesce(seen("n_blocked"), F.lit(0)) + PRIOR * mean) / (F.coalesce(seen("n_labels"), F.lit(0)) + PRIOR)
        rows = met.withColumns({
            f"{s}_urls": F.log1p(F.coalesce("n_urls", F.lit(0)).cast("double")), f"{s}_rate": rate,
        }).drop("n_urls", "n_labels", "n_blocked")
    return rows


FEATURES = [*LEXICAL, *[f"{s}_{x}" for s in SUFFIXES for x in ("urls", "rate")]]


def training_rows(urls: DataFrame, statistics: DataFrame, mean: float, max_rows: int) -> DataFrame:
    """Features, y and weight of at most ``max_rows`` distinct labelled URLs of each verdict."""
    rows = urls.withColumn("y", _label()).where("y IS NOT NULL")
    of = lambda y: rows.where(F.col("y") == y).dropDuplicates(["u"]).orderBy("u").limit(max_rows)
    chosen = cut(of(0).unionByName(of(1)), "url-sample")
    return _with_statistics(chosen, statistics, mean, fit=True)


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url",
               max_rows: int = MAX_ROWS) -> DataFrame:
    """``key``, host, path, rule, verdict and score (how likely the trees find it to be blocked).

    The verdict is that of the longest fitting rule, else of the trees: block
    from a score of 0.5 on.  Null URLs and those without ``://`` have an empty
    host and path, fit no rule and are judged by the trees as well.  If all
    labelled URLs have one verdict, the others get that one (score 0 or 1); if
    none is labelled, they are allowed.  Keys may be null or repeated; each row
    gives a row.  An empty table gives an empty one; other columns are not read.
    """
    urls = cut(described(pages, rules, key, url), "urls")
    y = _label()
    n = urls.agg(F.count(y).alias("all"), F.coalesce(F.sum(y), F.lit(0)).alias("blocked")).first()
    if 0 < n["blocked"] < n["all"]:
        mean = n["blocked"] / n["all"]
        statistics = cut(suffix_statistics(urls), "url-suffixes")
        sample = cut(training_rows(urls, statistics, mean, max_rows), "url-training")
        counts = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        # the sample has as many of either verdict as it can; weights bring the shares back
        weight = F.when(F.col("y") == 1, mean / counts[1]).otherwise((1 - mean) / counts[0]) * sum(counts.values())
        vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(
            labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=17, checkpointInterval=-1
        )
        model = trees.fit(vector.transform(sample.withColumn("weight", weight)).select("features", "y", "weight"))
        seen = _with_statistics(urls, statistics, mean, fit=False)
        seen = model.transform(vector.transform(seen))
        scored = seen.select("key", "host", "path", "rule", "verdict", vector_to_array("probability")[1].alias("score"))
    else:
        scored = urls.select("key", "host", "path", "rule", "verdict", F.lit(1.0 if n["blocked"] else 0.0).alias("score"))
    learned = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "score"
    )
