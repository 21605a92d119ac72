"""Candidate curation: admission, relevance, quotas, names, manifest rebuild."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions.classes import literal_lookup
from boxlake.operators.neardup import hamming

# Words that mark non-photographs, for page titles and descriptions.
EXCLUDED_MEDIA_WORDS = (
    "illustration", "diagram", "drawing", "painting", "artwork", "icon", "logo", "map",
    "animation", "render", "rendered", "synthetic", "midjourney", "stable diffusion", "dall-e",
    "ai generated", "generated ai", "screenshot", "comic", "poster", "chart", "schema", "3d model",
)
# Words that mark non-photographs, for search results.
EXCLUDED_SEARCH_WORDS = (
    "illustration", "drawing", "painting", "render", "rendered", "digital art", "artwork",
    "diagram", "logo", "icon", "poster", "comic", "midjourney", "stable diffusion", "dall-e",
    "ai generated", "generative ai", "synthetic", "3d model", "clipart",
)
# Licence text that must occur, and that must not.
ALLOWED_LICENCES = (
    "public domain", "cc0", "pdm", "cc by ", "cc-by-", "cc by-sa", "cc-by-sa",
)
DENIED_LICENCES = ("noncommercial", "no derivatives")
# Exact licence codes and sources of the search feed.
SEARCH_LICENCES = ("cc0", "pdm", "by", "by-sa")
SEARCH_SOURCES = ("flickr", "wikimedia", "nasa", "smithsonian", "clevelandmuseum")
ALLOWED_MIME = ("image/jpeg", "image/png", "image/webp")

# Images wanted per category, in processing order.
TARGETS = {"pipe_burst": 72, "water_drops": 34, "water_accumulation": 22}

# Terms worth five points each, per category.
RELEVANT_TERMS = {
    "pipe_burst": (
        "burst", "broken", "rupture", "main break", "pipeline leak", "pipe leak", "leaking pipe",
        "water leak",
    ),
    "water_drops": ("droplet", "water drop", "drip", "dripping", "falling drop"),
    "water_accumulation": (
        "puddle", "standing water", "water damage", "flooded", "flooding", "wet floor",
    ),
}


def _bound(text: Column, body: Callable[[Column], Column]) -> Column:
    """`body(text)` with `text` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(text), body), F.lit(0))


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    """Any of the words occurs in the text. Plain substring tests, far cheaper than a regex."""
    return _bound(text, lambda s: reduce(lambda a, b: a | b, [s.contains(w) for w in words]))


def page_reject_reason() -> Column:
    """First rule a flattened page candidate breaks; null when admitted."""
    searchable = F.lower(F.concat_ws(" ", "title", "description", "object_name"))
    licence = F.lower("license_name")
    return (
        F.when(~F.coalesce(F.col("mime").isin(*ALLOWED_MIME), F.lit(False)), "mime not allowed")
        .when(mentions(searchable, EXCLUDED_MEDIA_WORDS), "not a photograph")
        .when(~mentions(licence, ALLOWED_LICENCES), "licence not allowed")
        .when(mentions(licence, DENIED_LICENCES), "licence restricted")
    )


def search_reject_reason(minimum_side: int = 300) -> Column:
    """First rule a search candidate (license, source, text, url, width, height) breaks."""
    licence = F.coalesce(F.lower("license"), F.lit(""))
    source = F.coalesce(F.lower("source"), F.lit(""))
    return (
        F.when(~licence.isin(*SEARCH_LICENCES), "license not in allowlist")
        .when(~source.isin(*SEARCH_SOURCES),
              F.concat(F.lit("source not in allowlist: "), source))
        .when(mentions(F.col("text"), EXCLUDED_SEARCH_WORDS),
              "non-photographic or AI-related metadata")
        .when(F.coalesce("url", F.lit("")) == "", "missing media URL")
        .when((F.col("width") < minimum_side) | (F.col("height") < minimum_side),
              "image smaller than 300 px")
    )


def relevance(
    category: Column, *texts: Column, terms: Mapping[str, tuple[str, ...]] = RELEVANT_TERMS
) -> Column:
    """Five points per category term in the joined text, three for "photograph"."""

    def points(text: Column, words: tuple[str, ...]) -> Column:
        hits = [F.when(text.contains(word), 5).otherwise(0) for word in words]
        return reduce(lambda a, b: a + b, hits)

    def score(text: Column) -> Column:
        scored = F.lit(0)
        for name, words in terms.items():
            scored = F.when(category == name, points(text, words)).otherwise(scored)
        return scored + F.when(text.contains("photograph"), 3).otherwise(0)

    return _bound(F.lower(F.concat_ws(" ", *texts)), score)


def rank_and_take(candidates: DataFrame, targets: Mapping[str, int] = TARGETS) -> DataFrame:
    """The best `max(7 * target, 250)` candidates per category with their `rank`."""
    depth = {name: max(7 * target, 250) for name, target in targets.items()}
    order = [F.col("relevance").desc(), F.lower("title").asc(), F.col("id").asc()]
    wanted = candidates.filter(F.col("category").isin(*targets))
    best = skew.top_k(wanted, ["category"], order, max(depth.values()), ["id"])
    limit = literal_lookup(F.col("category"), depth, F.lit(0))
    return best.filter(F.col("row_number") <= limit).withColumn(
        "rank", F.col("row_number").cast("long")
    ).drop("row_number")


def _early_reason() -> Column:
    return F.when(F.col("too_small"), "image smaller than 300 px").when(
        F.col("known_duplicate"), "near-duplicate of existing repository image"
    )


def quota_select(
    ranked: DataFrame, targets: Mapping[str, int], words: int, limit: int = 5
) -> DataFrame:
    """Greedy acceptance over the output of `rank_and_take`, category by category.

    A candidate is accepted unless it is too small, near a known image or near one accepted before
    it (in any category); a category stops at its target, and what follows is neither accepted nor
    rejected. The rows folded here are bounded by the targets (`max(7 * target, 250)` each), not by
    the data, so one JVM fold holds them all.
    """
    order = {name: i for i, name in enumerate(targets)}
    position = literal_lookup(F.col("category"), order, F.lit(None).cast("int"))
    rows = ranked.select(
        position.alias("c"), "rank", "id", "category", "words", _early_reason().alias("early")
    )
    listed = rows.agg(
        F.array_sort(F.collect_list(F.struct("c", "rank", "id", "category", "words", "early")))
        .alias("rows")
    )
    start = F.struct(
        F.expr("CAST(array() AS ARRAY<STRUCT<c: INT, words: ARRAY<BIGINT>>>)").alias("accepted"),
        F.expr("CAST(array() AS ARRAY<STRING>)").alias("fates"),
    )

    def step(state: Column, row: Column) -> Column:
        accepted = state.getField("accepted")
        mine = F.size(F.filter(accepted, lambda a: a.getField("c") == row.getField("c")))
        full = mine >= literal_lookup(row.getField("category"), dict(targets), F.lit(0))
        near = F.exists(
            accepted, lambda a: hamming(a.getField("words"), row.getField("words"), words) <= limit
        )
        fate = (
            F.when(full, "unprocessed")
            .when(row.getField("early").isNotNull(), row.getField("early"))
            .when(near, "near-duplicate within new collection")
            .otherwise("accepted")
        )
        entry = F.struct(row.getField("c").alias("c"), row.getField("words").alias("words"))
        return F.struct(
            F.when(fate == "accepted", F.array_append(accepted, entry))
            .otherwise(accepted).alias("accepted"),
            F.array_append(state.getField("fates"), fate).alias("fates"),
        )

    fates = F.aggregate("rows", start, step, lambda s: s.getField("fates"))
    paired = listed.select(F.explode(F.arrays_zip("rows", fates.alias("fates"))).alias("p"))
    decided = paired.select("p.rows.id", "p.rows.category", "p.rows.rank", F.col("p.fates").alias("f"))
    return decided.filter(F.col("f") != "unprocessed").select(
        "id", "category", "rank",
        F.when(F.col("f") == "accepted", "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("f") != "accepted", F.col("f")).alias("reason"),
    )


def _no_decisions(rows: DataFrame) -> DataFrame:
    """The empty result: a category that wants nothing looks at nothing."""
    return rows.filter(F.lit(False)).select(
        "id", "category", F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("reason"),
    )


def quota_select_open(
    candidates: DataFrame, targets: Mapping[str, int], words: int, limit: int = 5,
    chunk: int = 500,
) -> DataFrame:
    """The same greedy acceptance for a feed that is not cut to a fixed depth.

    Rows are visited by (`order_key` ascending) inside each category. Every round looks at the best
    `chunk` rows that no accepted image rules out; at least one is accepted per round, so there are
    at most `target` rounds. Only accepted fingerprints (bounded by the targets) reach the driver;
    one row-wise pass then labels every candidate up to the point where its category filled up.
    """
    accepted: list[tuple[int, list[int]]] = []
    parts: list[DataFrame] = []

    def near(entries: list[tuple[int, list[int]]]) -> Column:
        if not entries:
            return F.lit(False)
        fixed = F.array(*[F.array(*[F.lit(w) for w in ws]) for _, ws in entries])
        return F.exists(fixed, lambda a: hamming(a, F.col("words"), words) <= limit)

    for category, target in targets.items():
        rows = candidates.filter(F.col("category") == category)
        open_rows = rows.filter(_early_reason().isNull())
        before = len(accepted)
        last_key = None
        while len(accepted) - before < target:
            left = open_rows.filter(~near(accepted))
            if last_key is not None:
                left = left.filter(F.col("order_key") > F.lit(last_key))
            best = (
                left.orderBy("order_key").limit(chunk).select("order_key", "id", "words").collect()
            )
            if not best:
                break
            for row in best:
                if len(accepted) - before == target:
                    break
                if all(_distance(row["words"], ws) > limit for _, ws in accepted):
                    accepted.append((row["id"], list(row["words"])))
                    last_key = row["order_key"]
        mine = accepted[before:]
        full = len(mine) == target
        if full and target == 0:
            parts.append(_no_decisions(rows))
            continue
        seen = rows if not full else rows.filter(F.col("order_key") <= F.lit(last_key))
        taken = F.col("id").isin(*[i for i, _ in mine]) if mine else F.lit(False)
        reason = F.coalesce(_early_reason(), F.lit("near-duplicate within new collection"))
        parts.append(seen.select(
            "id", "category",
            F.when(taken, "accepted").otherwise("rejected").alias("status"),
            F.when(~taken, reason).alias("reason"),
        ))
    result = parts[0] if parts else _no_decisions(candidates)
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _distance(a, b) -> int:
    return sum((int(x) ^ int(y)).bit_count() for x, y in zip(a, b, strict=True))


def candidate_filename(category: Column, number: Column, page_id: Column, digest: Column) -> Column:
    """`category_NNN_page_digest12.jpg`"""
    text = number.cast("string")
    padded = F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)
    return F.concat(
        F.concat_ws("_", category, padded, page_id.cast("string"), F.substring(digest, 1, 12)),
        F.lit(".jpg"),
    )


_NAME = r"(?i)_([0-9]+)_([0-9a-f]{12})\.jpg$"


def parse_candidate_filename(name: Column) -> tuple[Column, Column]:
    """(page id, digest12), null when the name has another form."""
    return (
        F.nullif(F.regexp_extract(name, _NAME, 1), F.lit("")).cast("long"),
        F.nullif(F.regexp_extract(name, _NAME, 2), F.lit("")),
    )


def rebuild_manifest(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Files joined with page metadata by the page id in their name; unknown pages give blanks.

    The last file (by path) of a page id wins; `pages` is the output of `flatten_pages`.
    """
    page_id, _ = parse_candidate_filename(F.col("path"))
    latest = files.select(page_id.alias("page_id"), "path").filter(
        F.col("page_id").isNotNull()
    ).groupBy("page_id").agg(F.max("path").alias("path"))
    columns = ["title", "page_url", "original_url", "author", "license_name", "description"]
    unique = pages.groupBy("page_id").agg(F.max(F.struct(*columns)).alias("_p"))
    joined = latest.join(unique, "page_id", "left")
    return joined.select(
        "page_id", "path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"),
        *[F.coalesce(F.col(f"_p.{c}"), F.lit("")).alias(c) for c in columns],
    )


def quota_totals(decisions: DataFrame, targets: Mapping[str, int]) -> DataFrame:
    """(category, reason, n, open): decisions by category and reason (null: accepted), and how many places
    of the category's target are still open. Categories without a decision have one row of zero."""
    counted = decisions.groupBy("category", "reason").agg(F.count(F.lit(1)).alias("n"))
    accepted = decisions.groupBy("category").agg(F.count_if(F.col("status") == "accepted").alias("_taken"))
    spine = decisions.sparkSession.createDataFrame(sorted(targets.items()), "category string, _target int")
    return spine.join(counted, "category", "left").join(accepted, "category", "left").select(
        "category", "reason", F.coalesce("n", F.lit(0)).alias("n"),
        (F.col("_target") - F.coalesce("_taken", F.lit(0))).cast("long").alias("open"),
    )
