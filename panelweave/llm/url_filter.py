"""URL verdicts: rules first, then boosted trees on the shape of the URL."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.sources import stage


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules, each for a host with its subdomains and for paths that begin alike.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Bound of the training sample: about so many URLs that a rule judges.
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 15, 4, 7
#: Judged URLs that the usual rate counts for in a suffix's rate.
SMOOTHING = 5.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FEATURES = (
    "f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens",
    "f_secure", "f_fragment", "f_suffix_blocked", "f_site_blocked", "f_section_blocked",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path behind the first ``://``; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Number of the longest rule that fits, else NULL; of equally long ones the first."""
    best = F.lit(None).cast("int")
    for number, rule in sorted(enumerate(rules), key=lambda r: (len(r[1].text), -r[0])):
        inside = (host == rule.host) | host.endswith(f".{rule.host}")
        best = F.when(inside & path.startswith(rule.path), number).otherwise(best)
    return best


def entropy(text: Column) -> Column:
    """Bits per character of a text."""
    signs = F.split(text, "")
    size = F.length(text)
    share = lambda sign: F.size(F.filter(signs, lambda other: other == sign)) / size
    return F.when(
        size > 0,
        F.aggregate(F.array_distinct(signs), F.lit(0.0), lambda total, sign: total - share(sign) * F.log2(share(sign))),
    ).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.substring_index(F.when(F.instr(url, "?") > 0, F.substring(url, F.instr(url, "?") + 1, F.length(url))), "#", 1)
    count = lambda text, sign: F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))
    values = {
        "f_length": F.length(url),
        "f_host": F.length(host),
        "f_path": F.length(path),
        "f_depth": F.size(F.array_remove(F.split(path, "/"), "")),
        "f_digits": F.when(F.length(url) > 0, digits / F.length(url)),
        "f_entropy": entropy(url),
        "f_params": F.when(F.length(query) > 0, count(query, "&") + 1),
        "f_labels": F.when(F.length(host) > 0, count(host, ".") + 1),
        "f_hyphens": count(url, "-"),
        "f_secure": url.startswith("https:").cast("int"),
        "f_fragment": F.when(F.instr(url, "#") > 0, 1),
    }
    return {name: F.coalesce(value.cast("double"), F.lit(0.0)) for name, value in values.items()}


def _statistics(shaped: DataFrame, name: str, label: Column, usual: float) -> DataFrame:
    """How often rules block a suffix, pulled to the usual rate where they judge few of its URLs."""
    rate = (F.coalesce(F.sum(label), F.lit(0.0)) + SMOOTHING * usual) / (F.count(label) + SMOOTHING)
    return shaped.groupBy(name).agg(rate.alias(f"f_{name}_blocked"))


def url_filter(
    pages: DataFrame,
    page: str = "page_id",
    url: str = "url",
    rules: Sequence[Rule] = RULES,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``pages``: ``host``, ``path``, ``rule``, ``verdict`` and ``blocked``, its chance.

    The rule that fits with the longest text decides. URLs without one are judged by boosted trees
    on lexical features and statistics of host suffixes and first path sections; they are trained on
    about ``sample_rows`` URLs that rules decide, picked by a hash. The statistics cover all pages.

    A missing URL, or one without ``://``, has an empty host and path and no rule. If no URL is
    decided by a rule, the rest is allowed; if all decided ones agree, the rest gets that verdict.
    Repeated rows and missing ids are judged each; other columns are ignored; an empty table
    gives an empty result.
    """
    host, path = host_and_path(F.col("url"))
    picked = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(page).alias("page"), F.col(url).alias("url")
    ).withColumns({"host": host, "path": path})
    picked = picked.withColumn("number", fitting_rule(F.col("host"), F.col("path"), rules))
    texts = F.array(*[F.lit(r.text) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    shaped = stage(
        picked.select(
            "row", "page", "url", "host", "path",
            F.get(texts, F.col("number")).alias("rule"),
            F.get(verdicts, F.col("number")).alias("told"),
            F.substring_index("host", ".", -1).alias("suffix"),
            F.substring_index("host", ".", -2).alias("site"),
            F.regexp_extract("path", "^/([^/]*)/", 1).alias("section"),
            *[c.alias(n) for n, c in lexical(F.coalesce(F.col("url"), F.lit("")), F.col("host"), F.col("path")).items()],
        ),
        "urls",
    )
    label = (F.col("told") == "block").cast("double")
    known = shaped.agg(F.count("told"), F.min("told"), F.max("told"), F.avg(label)).first()
    full = shaped.withColumn("label", label)
    for name in ("suffix", "site", "section"):
        full = full.join(_statistics(shaped, name, label, known[3] or 0.0), name)

    plain = full.select("page", "host", "path", "rule", "told")
    if known[0] == 0 or known[1] == known[2]:
        blocked = F.lit(1.0 if known[1] == "block" else 0.0)
        judged = plain.withColumn("blocked", blocked)
    else:
        chance = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        sample = full.where(F.col("label").isNotNull() & (chance * known[0] <= sample_rows))
        sample = sample.repartition(4, F.xxhash64("row")).sortWithinPartitions("row")
        trees = GBTClassifier(
            labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, predictionCol="_verdict"
        )
        model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), trees]).fit(sample)
        judged = model.transform(full).withColumn("blocked", vector_to_array("probability")[1])
    verdict = F.coalesce("told", F.when(F.col("blocked") >= 0.5, "block").otherwise("allow"))
    return judged.select(F.col("page").alias(page), "host", "path", "rule", verdict.alias("verdict"), "blocked")
