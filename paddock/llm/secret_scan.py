"""Secret scans with corpus-wide ownership frequency, in SQL functions only.

Three patterns give the base spans. The corpus then tells examples from live
credentials: the hash of every candidate value is counted over distinct repositories
and owners. A long mixed token that no keyword announces becomes a span of its own when
it belongs to one owner alone; a value that several owners carry is an example.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, text_or_empty

# fixed values: the patterns of the base spans, with the group that holds the value
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs of fewer characters fail whole, so asking for the length finds the same spans
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"[A-Za-z0-9_]{20,}"
KINDS = ("assign", "access", "hex", "live")


def pieces(kind: int, text: Column, pattern: str, group: int, keep: Callable[[Column], Column], hint: str) -> Column:
    """Array of (kind, pos, gap, len, keep, h1, h2): leftmost non-overlapping matches, each with the
    code points between it and the one before. ``keep``: which values count. ``hint``: a
    cheaper pattern that every text with a match contains.

    Nothing is accumulated over the array, so the work is linear in the text.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def piece(x: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("pos"),
            F.char_length(x["gap"]).cast("long").alias("gap"),
            F.char_length(x["whole"]).cast("long").alias("len"),
            keep(x["value"]).alias("keep"),
            F.xxhash64(x["value"]).alias("h1"),
            F.xxhash64(F.lit(1), x["value"]).alias("h2"),
        )

    # behind the last match there is one more gap
    found = F.filter(F.transform(zipped, piece), lambda p: p["len"].isNotNull())
    return F.when(text.rlike(hint), found).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:bigint,len:bigint,keep:boolean,h1:bigint,h2:bigint>>"))


def text_pieces(text: Column) -> Column:
    """The matches of all kinds; kind 3 still needs the corpus."""
    every = lambda _: F.lit(True)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    return F.concat(
        pieces(0, text, ASSIGN, 1, lambda v: F.char_length(v) >= 6, r"(?i:password|passwd|secret|token|api_?key)"),
        pieces(1, text, ACCESS, 0, every, "AKIA"),
        pieces(2, text, HEX, 0, every, r"[0-9a-f]{24}"),
        pieces(3, text, MIXED, 0, mixed, MIXED),
    )


def placed(rows: DataFrame) -> DataFrame:
    """Rows (row, repo, owner, start, kind, end, h1, h2) of rows with ``found``: places are sums of the pieces before."""
    each = rows.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("x")).select("row", "repo", "owner", "x.*")
    before = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    spans = each.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("len")).cast("int"))
    return spans.where("keep").select("row", "repo", "owner", "start", "kind", "end", "h1", "h2")


def listed(spans: Column) -> Column:
    """kind:start:end, joined with commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    max_owners: int = 1,
    max_repos: int = 3,
) -> DataFrame:
    """One row per input row: doc_id, ``base`` and ``spans`` (arrays of start, kind, end), n_live, n_copied.

    Base spans (kinds 0 to 2: assign, access, hex) depend on the text alone. Span kind 3
    (live) is a token of 20 or more letters, digits and underscores of both cases with a
    digit, whose value at most ``max_owners`` owners and ``max_repos`` repositories have.
    ``n_live`` and ``n_copied`` count the document's candidates on either side of that line,
    base spans included. Null text is empty; null repositories and owners each count as one.
    Repeated rows are rows of their own (one repository). An empty table gives no rows;
    other columns are ignored.

    The work is linear in a text. Texts don't travel: only their matches' lengths and hashes
    do. A text's matches of one kind are summed up in one window. Values are counted over distinct (value,
    owner, repository) rows with partial sums, and joined back by value hash with one row
    per value on that side, so a value that is everywhere can be split.
    """
    rows = store(
        docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text_or_empty(text_col).alias("_text"))
        .select("doc_id", "repo", "owner", text_pieces(F.col("_text")).alias("found"))
        .withColumn("row", F.monotonically_increasing_id()),
        "secrets",
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    each = store(placed(rows), "spans")
    some = lambda c: F.coalesce(F.col(c), F.lit("\x00"))
    owners = each.select("h1", "h2", some("owner").alias("owner"), some("repo").alias("repo")).distinct()
    owners = owners.groupBy("h1", "h2", "owner").agg(F.count(F.lit(1)).alias("repos"))
    seen = owners.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    own = seen.select("h1", "h2", ((F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).alias("own"))
    span = F.struct("start", "kind", "end")
    judged = each.join(own, ["h1", "h2"]).groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("own"), span))).alias("spans"),
        F.sum(F.col("own").cast("long")).alias("n_live"),
        F.sum((~F.col("own")).cast("long")).alias("n_copied"),
    )
    out = rows.select("doc_id", "row").join(judged, "row", "left").withColumn("spans", F.coalesce("spans", none))
    return out.select(
        "doc_id",
        F.filter("spans", lambda x: x["kind"] < 3).alias("base"),
        "spans",
        F.coalesce("n_live", F.lit(0)).alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )
