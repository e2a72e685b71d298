"""Secrets in texts, told apart by who else holds them. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.sources import stage


@dataclass(frozen=True)
class Kind:
    """``value``: the group that holds the secret. ``min_value``, ``min_match``: sizes below are dropped.

    ``specific``: such a match counts only where it looks random and one owner alone holds it.
    """

    name: str
    pattern: str
    value: int = 0
    min_value: int = 0
    specific: bool = False


# Patterns and least sizes of the kinds of secrets.
KINDS = (
    Kind(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value=2,
        min_value=12,
    ),
    Kind("access", r"AKIA[A-Z0-9]+", min_value=18),
    Kind("hex", r"[0-9a-f]{16,}", min_value=16),
    Kind("blob", r"[A-Za-z0-9+/_-]{24,}", min_value=24, specific=True),
)
#: A value that this many owners hold is a copied example.
EXAMPLE_OWNERS = 3


def _matches(text: Column, kind: Kind, rank: int) -> Column:
    """Every match of a kind with the length of the text between it and the match before."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    rows = F.transform(
        found,
        lambda match, i: F.struct(
            F.lit(rank).alias("kind"),
            i.alias("nth"),
            F.length(match).alias("size"),
            match.alias("match"),
        ),
    )
    # The text is cut only where something was found.
    lengths = F.when(F.size(found) > 0, F.transform(gaps, lambda gap: F.length(gap)))
    return F.struct(rows.alias("rows"), lengths.alias("gaps"))


def _with_gaps(matches: str) -> Column:
    gaps = F.col(f"{matches}.gaps")
    return F.transform(F.col(f"{matches}.rows"), lambda r: r.withField("gap", F.get(gaps, r["nth"])))


def secret_scan(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    kinds: Sequence[Kind] = KINDS,
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per row of ``docs`` with ``found``: its secrets in order of start, then kind.

    Each of them has ``kind``, ``start`` and ``end`` in code points, and what the whole corpus says
    about its value: in how many ``repositories`` and with how many ``owners`` it occurs, and
    ``live``, true where fewer than ``example_owners`` owners hold it. ``number`` is true for a
    match without any letter, which is a card or order number rather than a credential, however
    few hold it. Matches of a kind are leftmost and do not overlap; those that are too short are dropped without a retry. Kinds
    marked ``specific`` are kept only if they mix cases and digits, overlap no other kind and
    belong to a single owner.

    Frequencies are summed per (value, owner, repository), then per owner, then per value, so a
    value that fills a third of the corpus never meets in one task row by row. A missing text is
    empty; a missing owner or repository counts as one of its own. Repeated rows are reported each.
    Columns of ``docs`` other than the four named are ignored; an empty table gives an empty result.
    """
    names = [k.name for k in kinds]
    content = F.coalesce(F.col(text), F.lit(""))
    picked = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc).alias("doc"),
        F.col(repository).alias("repository"),
        F.col(owner).alias("owner"),
        content.alias("text"),
    )
    scanned = stage(
        picked.select(
            "row", "doc", "repository", "owner",
            *[_matches(F.col("text"), kind, i).alias(f"m{i}") for i, kind in enumerate(kinds)],
        ),
        "secrets",
    )

    one_each = F.concat(*[_with_gaps(f"m{i}") for i in range(len(kinds))])
    matches = scanned.select("row", "repository", "owner", F.explode(one_each).alias("r")).select(
        "row", "repository", "owner", "r.*"
    )
    so_far = Window.partitionBy("row", "kind").orderBy("nth")
    placed = matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn(
        "start", F.col("end") - F.col("size")
    )
    value = F.col("match")
    least = F.lit(0)
    special = F.lit(False)
    for i, kind in enumerate(kinds):
        mine = F.col("kind") == i
        if kind.value:
            value = F.when(mine, F.regexp_extract("match", kind.pattern, kind.value)).otherwise(value)
        least = F.when(mine, kind.min_value).otherwise(least)
        special = special | (mine & F.lit(kind.specific))
    random_looking = F.col("match").rlike("[A-Z]") & F.col("match").rlike("[a-z]") & F.col("match").rlike("[0-9]")
    kept = placed.withColumns({"value": value, "special": special}).where(
        (F.length("value") >= least) & (~F.col("special") | random_looking)
    )
    # A special match must not overlap another kind: the furthest end so far and the next start decide.
    by_start = Window.partitionBy("row").orderBy("start", "kind", "end")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    plain_end, plain_start = F.when(~F.col("special"), F.col("end")), F.when(~F.col("special"), F.col("start"))
    clear = (F.coalesce(F.max(plain_end).over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(plain_start).over(after), F.col("end")) >= F.col("end")
    )
    candidates = stage(
        kept.withColumn("clear", clear)
        .where(~F.col("special") | F.col("clear"))
        .select(
            "row", "kind", "start", "end", "special", "repository", "owner",
            F.sha2("value", 256).alias("value"),
            (~F.col("match").rlike("[A-Za-z]")).alias("number"),
        ),
        "secret-candidates",
    )

    frequency = (
        candidates.select("value", "owner", "repository")
        .distinct()
        .groupBy("value", "owner")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value")
        .agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    )
    told = (
        candidates.drop("repository", "owner")
        .join(frequency, "value")
        .where(~F.col("special") | (F.col("owners") == 1))
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "start", "kind", "end", "repositories", "owners",
                        (F.col("owners") < example_owners).alias("live"), "number",
                    )
                )
            ).alias("found")
        )
    )
    label = F.array(*[F.lit(n) for n in names])
    found = F.transform(
        F.coalesce("found", F.array()),
        lambda r: F.struct(
            label[r["kind"]].alias("kind"),
            r["start"].alias("start"),
            r["end"].alias("end"),
            r["repositories"].alias("repositories"),
            r["owners"].alias("owners"),
            r["live"].alias("live"),
            r["number"].alias("number"),
        ),
    )
    return scanned.select("row", "doc").join(told, "row", "left").select(F.col("doc").alias(doc), found.alias("found"))


def span_text(found: Column) -> Column:
    """``kind:start:end`` of every item, joined by commas."""
    return F.array_join(
        F.transform(found, lambda r: F.concat_ws(":", r["kind"], r["start"].cast("string"), r["end"].cast("string"))), ","
    )
