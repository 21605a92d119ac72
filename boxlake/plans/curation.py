"""Candidate metadata, relevance, near-duplicate and quota queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.functions import text as t
from boxlake.operators import curate, dedupe, fingerprint, neardup
from boxlake.plans.fixtures import table
from boxlake.plans.registry import Registry
from boxlake.sources import candidates as source
from boxlake.sources import images as image_files

curation = Registry()


def clean_sql(expression: str) -> str:
    """The oracle's form of the HTML clean-up."""
    for entity, plain in t.COMMON_ENTITIES.items():
        plain = plain.replace("'", "''")
        expression = f"replace({expression}, '{entity.replace(chr(39), chr(39) * 2)}', '{plain}')"
    untagged = f"regexp_replace({expression}, '<[^>]+>', ' ', 'g')"
    return rf"trim(regexp_replace({untagged}, '[\s\x{{00A0}}]+', ' ', 'g'))"


@curation.add("html_clean", f"SELECT page_id, {clean_sql('html')} AS cleaned FROM pages")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", t.clean_html(F.col("html")).alias("cleaned")
    )


_PAGE_EXPRESSIONS = """
    SELECT doc_id, concat('File:', lang, ' ', CAST(doc_id AS VARCHAR(20)), '.jpg') AS title, doc_id % 37 = 0 AS missing,
           doc_id % 41 = 0 AS bare,
           CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/tiff' ELSE 'image/jpeg' END AS mime,
           concat('https://files.example/', CAST(doc_id AS VARCHAR(20))) AS url,
           CASE WHEN doc_id % 2 = 0 THEN concat('https://thumbs.example/', CAST(doc_id AS VARCHAR(20))) ELSE '' END AS thumb,
           CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('<b>', source, '</b> &amp; co') END AS artist,
           concat('credit ', source) AS credit,
           CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'CC BY-SA 4.0' WHEN 2 THEN 'CC BY NonCommercial'
                WHEN 3 THEN 'Public domain' WHEN 4 THEN 'All rights reserved' ELSE 'cc0' END AS license,
           CASE doc_id % 14 WHEN 0 THEN 'Public domain' ELSE 'unclear' END AS terms,
           concat(text, CASE doc_id % 11 WHEN 0 THEN ' a diagram' WHEN 1 THEN ' <i>stable diffusion</i>' ELSE '' END) AS description
    FROM documents"""

_FLAT_CTE = f"""
    pages_raw AS ({_PAGE_EXPRESSIONS}),
    flat AS (
        SELECT doc_id AS page_id, title, mime, concat('https://pages.example/', CAST(doc_id AS VARCHAR)) AS page_url,
               url AS original_url, CASE WHEN thumb = '' THEN url ELSE thumb END AS download_url,
               CASE WHEN artist = '' THEN credit ELSE {clean_sql('artist')} END AS author,
               CASE WHEN license = '' THEN terms ELSE license END AS license_name,
               {clean_sql('description')} AS description,
               CASE WHEN doc_id % 4 = 0 THEN 'late ' || lang WHEN doc_id % 4 = 1 THEN 'early ' || lang ELSE '' END AS source_category
        FROM pages_raw JOIN (SELECT doc_id, lang FROM documents) AS d USING (doc_id)
        WHERE NOT missing AND NOT bare)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw page JSON, as a metadata feed would deliver it."""
    table(spark, sf_dir, "documents").createOrReplaceTempView("_boxlake_documents")
    raw = spark.sql(_PAGE_EXPRESSIONS.replace("FROM documents", "FROM _boxlake_documents"))
    value = "named_struct('value', {})"
    meta = ", ".join(
        f"'{key}', {value.format(column)}"
        for key, column in (
            ("Artist", "artist"), ("Credit", "credit"), ("LicenseShortName", "license"),
            ("UsageTerms", "terms"), ("ImageDescription", "description"),
        )
    )
    info = (
        "named_struct('url', url, 'thumburl', thumb, 'descriptionurl', "
        "concat('https://pages.example/', CAST(doc_id AS STRING)), 'mime', mime, "
        f"'extmetadata', map({meta}))"
    )
    return raw.selectExpr(
        "to_json(named_struct('pageid', doc_id, 'title', title, 'missing', missing, "
        f"'imageinfo', IF(bare, NULL, array({info})))) AS body"
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title to source entries; some titles are listed twice and the later entry wins."""
    return table(spark, sf_dir, "documents").filter("doc_id % 4 < 2").selectExpr(
        "concat('File:', lang, ' ', CAST(doc_id AS STRING), '.jpg') AS title", "doc_id % 4 AS m", "lang",
    ).selectExpr(
        "title",
        "inline(IF(m = 0, array(named_struct('seq', 1, 'source_category', concat('early ', lang)), "
        "named_struct('seq', 2, 'source_category', concat('late ', lang))), "
        "array(named_struct('seq', 1, 'source_category', concat('early ', lang)))))",
    )


@curation.add(
    "candidate_flatten",
    f"""
    WITH {_FLAT_CTE.strip()}
    SELECT * FROM flat""",
)
def candidate_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = source.flatten_pages(_pages(spark, sf_dir), _sources(spark, sf_dir))
    return flat.drop("license_url", "object_name")


_WORDS = "|".join(curate.EXCLUDED_MEDIA_WORDS)
_ALLOWED = "|".join(curate.ALLOWED_LICENCES)


@curation.add(
    "candidate_admission",
    f"""
    WITH {_FLAT_CTE.strip()}
    SELECT page_id, CASE WHEN mime NOT IN ('image/jpeg', 'image/png', 'image/webp') THEN 'mime not allowed'
             WHEN regexp_matches(lower(concat_ws(' ', title, description, '')), '{_WORDS}') THEN 'not a photograph'
             WHEN NOT regexp_matches(lower(license_name), '{_ALLOWED}') THEN 'licence not allowed'
             WHEN regexp_matches(lower(license_name), 'noncommercial|no derivatives') THEN 'licence restricted' END AS reject_reason
    FROM flat""",
)
def candidate_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = source.flatten_pages(_pages(spark, sf_dir))
    return flat.select("page_id", curate.page_reject_reason().alias("reject_reason"))


@curation.add(
    "search_admission",
    f"""
    WITH s AS (
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'by-nc' WHEN 1 THEN NULL WHEN 2 THEN 'BY' WHEN 3 THEN 'cc0' ELSE 'by-sa' END AS license,
               CASE doc_id % 4 WHEN 0 THEN 'Flickr' WHEN 1 THEN 'nasa' WHEN 2 THEN 'wikimedia' ELSE 'stocksite' END AS source,
               lower(concat(coalesce(text, ''), ' ', lang, ' ', CASE WHEN doc_id % 9 = 2 THEN 'Digital Art' ELSE 'tag' END)) AS text,
               CASE WHEN doc_id % 13 = 3 THEN '' ELSE 'u' END AS url, 250 + doc_id % 300 AS side FROM documents)
    SELECT doc_id, text, CASE WHEN license IS NULL OR lower(license) NOT IN ('cc0', 'pdm', 'by', 'by-sa') THEN 'license not in allowlist'
             WHEN lower(source) NOT IN ('flickr', 'wikimedia', 'nasa', 'smithsonian', 'clevelandmuseum') THEN 'source not in allowlist: ' || lower(source)
             WHEN regexp_matches(text, '{"|".join(curate.EXCLUDED_SEARCH_WORDS)}') THEN 'non-photographic or AI-related metadata'
             WHEN url = '' THEN 'missing media URL' WHEN side < 300 THEN 'image smaller than 300 px' END AS reject_reason
    FROM s""",
)
def search_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 5 WHEN 0 THEN 'by-nc' WHEN 1 THEN NULL WHEN 2 THEN 'BY' WHEN 3 THEN 'cc0' ELSE 'by-sa' END AS license",
        "CASE doc_id % 4 WHEN 0 THEN 'Flickr' WHEN 1 THEN 'nasa' WHEN 2 THEN 'wikimedia' ELSE 'stocksite' END AS source",
        "text AS title",
        "array(named_struct('name', lang), named_struct('name', IF(doc_id % 9 = 2, 'Digital Art', 'tag'))) AS tags",
        "IF(doc_id % 13 = 3, '', 'u') AS url", "250 + doc_id % 300 AS width", "250 + doc_id % 300 AS height",
    )
    worded = results.withColumn("text", source.search_text(F.col("title"), F.col("tags")))
    return worded.select("doc_id", "text", curate.search_reject_reason().alias("reject_reason"))


_CATEGORY = (
    "CASE {} % 3 WHEN 0 THEN 'pipe_burst' WHEN 1 THEN 'water_drops' ELSE 'water_accumulation' END"
)
_PHRASES = (
    "burst pipe leak", "droplet dripping", "puddle photograph", "flooded wet floor", "plain",
    "broken main break photograph", "water drop",
)
_PHRASE = "CASE doc_id % 7 {} END".format(
    " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES))
)


def _points(words: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN contains(body, '{w}') THEN 5 ELSE 0 END" for w in words)


_SMALL_TARGETS = {"pipe_burst": 40, "water_drops": 25, "water_accumulation": 15}


@curation.add(
    "relevance_rank",
    f"""
    WITH d AS (
        SELECT doc_id AS id, {_CATEGORY.format('doc_id')} AS category, concat('File ', {_PHRASE}, ' ', CAST((doc_id * 7919) % 1009 AS VARCHAR)) AS title,
               text, source FROM documents),
    s AS (SELECT *, lower(concat_ws(' ', title, text, source)) AS body FROM d),
    r AS (
        SELECT *, CASE category WHEN 'pipe_burst' THEN {_points(curate.RELEVANT_TERMS['pipe_burst'])}
                  WHEN 'water_drops' THEN {_points(curate.RELEVANT_TERMS['water_drops'])}
                  ELSE {_points(curate.RELEVANT_TERMS['water_accumulation'])} END
               + CASE WHEN contains(body, 'photograph') THEN 3 ELSE 0 END AS relevance FROM s)
    SELECT id, category, title, relevance, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY relevance DESC, lower(title), id) AS rank FROM r) AS n
    WHERE rank <= CASE category WHEN 'pipe_burst' THEN 280 ELSE 250 END""",
)
def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", f"{_CATEGORY.format('doc_id')} AS category",
        f"concat('File ', {_PHRASE}, ' ', CAST((doc_id * 7919) % 1009 AS STRING)) AS title",
        "text", "source",
    )
    scored = rows.withColumn(
        "relevance",
        curate.relevance(F.col("category"), F.col("title"), F.col("text"), F.col("source")),
    ).drop("text", "source")
    return curate.rank_and_take(scored, _SMALL_TARGETS).select(
        "id", "category", "title", "relevance", "rank"
    )


_HASH_SPARK = (
    "aggregate(sequence(1, 64), 0L, "
    "(a, i) -> a | IF(embedding[i - 1] > 0, shiftleft(1L, i - 1), 0L))"
)
_HASH_SQL = (
    "(CAST(list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i] > 0 "
    "THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)) AS BIGINT) "
    "+ CASE WHEN embedding[64] > 0 THEN CAST(-9223372036854775808 AS BIGINT) ELSE 0 END)"
)


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id", f"{_HASH_SPARK} AS h")


@curation.add(
    "near_dup_join",
    f"""
    WITH k AS (SELECT vec_id, {_HASH_SQL} AS h FROM embeddings),
    c AS (SELECT vec_id + 1000000 AS id, xor(h, (CAST(1 AS BIGINT) << (vec_id % 8)) - 1) AS h FROM k)
    SELECT c.id, c.h, EXISTS (SELECT 1 FROM k WHERE bit_count(xor(k.h, c.h)) <= 5) AS near_duplicate FROM c""",
)
def near_dup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _hashes(spark, sf_dir)
    known = hashed.selectExpr("array(h) AS words")
    candidates = hashed.selectExpr(
        "vec_id + 1000000 AS id",
        "array(h ^ (shiftleft(1L, CAST(vec_id % 8 AS INT)) - 1)) AS words",
    )
    flagged = neardup.flag_near_duplicates(candidates, known, words=1, word_bits=64)
    return flagged.select("id", F.get("words", F.lit(0)).alias("h"), "near_duplicate")


def _quota_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates flagged against known ones."""
    rows = _hashes(spark, sf_dir).selectExpr(
        "vec_id AS id", f"{_CATEGORY.format('vec_id')} AS category",
        "array(h) AS words", "CAST((vec_id * 37) % 11 AS INT) AS relevance",
        "concat('T', CAST((vec_id * 7919) % 1009 AS STRING)) AS title",
        "(vec_id * 53) % 400 < 30 AS too_small",
    )
    known = rows.filter("id % 5 = 0").select("words")
    return neardup.flag_near_duplicates(
        rows.filter("id % 5 <> 0"), known, words=1, word_bits=63, name="known_duplicate"
    )


_QUOTA_CTE = f"""
    WITH RECURSIVE raw AS (
        SELECT vec_id AS id, vec_id % 3 AS c, {_CATEGORY.format('vec_id')} AS category, {_HASH_SQL} AS h,
               (vec_id * 37) % 11 AS relevance, 'T' || CAST((vec_id * 7919) % 1009 AS VARCHAR) AS title,
               (vec_id * 53) % 400 < 30 AS too_small FROM embeddings),
    flagged AS (
        SELECT *, CASE vec.c WHEN 0 THEN 40 WHEN 1 THEN 25 ELSE 15 END AS target,
               EXISTS (SELECT 1 FROM raw AS k WHERE k.id % 5 = 0 AND bit_count(xor(k.h, vec.h)) <= 5) AS known_duplicate
        FROM raw AS vec WHERE id % 5 <> 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY {{order}}) AS rank FROM flagged),
    numbered AS (
        SELECT *, row_number() OVER (ORDER BY c, rank) AS rn FROM ranked WHERE {{depth}}),
    fold AS (
        SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS id, CAST(-1 AS BIGINT) AS c, CAST(0 AS BIGINT) AS taken,
               CAST([] AS BIGINT[]) AS kept, '' AS fate
        UNION ALL
        SELECT rn, id, c, CASE WHEN fate = 'accepted' THEN taken + 1 ELSE taken END,
               CASE WHEN fate = 'accepted' THEN list_append(kept, h) ELSE kept END, fate
        FROM (
            SELECT r.rn, r.id, r.c, r.h, f.kept, CASE WHEN r.c = f.c THEN f.taken ELSE 0 END AS taken,
                   CASE WHEN r.c = f.c AND f.taken >= r.target THEN 'unprocessed'
                        WHEN r.too_small THEN 'image smaller than 300 px'
                        WHEN r.known_duplicate THEN 'near-duplicate of existing repository image'
                        WHEN len(list_filter(f.kept, lambda k: bit_count(xor(k, r.h)) <= 5)) > 0
                        THEN 'near-duplicate within new collection' ELSE 'accepted' END AS fate
            FROM fold AS f JOIN numbered AS r ON r.rn = f.rn + 1) AS s)
    SELECT n.id, n.category, {{extra}} CASE WHEN f.fate = 'accepted' THEN 'accepted' ELSE 'rejected' END AS status,
           CASE WHEN f.fate <> 'accepted' THEN f.fate END AS reason
    FROM fold AS f JOIN numbered AS n ON n.rn = f.rn WHERE f.fate <> 'unprocessed'"""


@curation.add(
    "quota_select",
    _QUOTA_CTE.format(
        order="relevance DESC, lower(title), id",
        depth="rank <= CASE c WHEN 0 THEN 280 ELSE 250 END", extra="n.rank,",
    ),
)
def quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = curate.rank_and_take(_quota_inputs(spark, sf_dir), _SMALL_TARGETS)
    return curate.quota_select(ranked, _SMALL_TARGETS, words=1)


_QUOTA_SELECT_SQL = _QUOTA_CTE.format(
    order="relevance DESC, lower(title), id", depth="rank <= CASE c WHEN 0 THEN 280 ELSE 250 END", extra="n.rank,",
)


@curation.add(
    "quota_totals",
    f"""
    WITH targets(category, target) AS (VALUES {', '.join(f"('{c}', {n})" for c, n in sorted(_SMALL_TARGETS.items()))}),
    counted AS (SELECT category, reason, count(*) AS n FROM ({_QUOTA_SELECT_SQL}) AS d GROUP BY category, reason)
    SELECT t.category, c.reason, coalesce(c.n, 0) AS n, target - coalesce(a.n, 0) AS open
    FROM targets AS t LEFT JOIN counted AS c ON c.category = t.category
    LEFT JOIN counted AS a ON a.category = t.category AND a.reason IS NULL""",
)
def quota_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.quota_totals(quota_select(spark, sf_dir), _SMALL_TARGETS)


@curation.add(
    "quota_select_open",
    _QUOTA_CTE.format(order="relevance <> 3, lower(title), id", depth="true", extra=""),
)
def quota_select_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The search feed prefers one source, then sorts by title.
    rows = _quota_inputs(spark, sf_dir).withColumn(
        "order_key",
        # A separator below every other character keeps the order of the columns themselves.
        F.concat_ws(
            "\0", F.when(F.col("relevance") == 3, "0").otherwise("1"), F.lower("title"),
            F.lpad(F.col("id").cast("string"), 19, "0"),
        ),
    )
    return curate.quota_select_open(rows, _SMALL_TARGETS, words=1)


@curation.add(
    "candidate_name",
    f"""
    WITH n AS (
        SELECT doc_id, {_CATEGORY.format('doc_id')} AS category, CAST(doc_id % 1500 + 1 AS VARCHAR) AS k, substr(sha256(text), 1, 12) AS digest FROM documents)
    SELECT category || '_' || CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END || '_' || CAST(doc_id AS VARCHAR) || '_' || digest || '.jpg' AS filename,
           doc_id AS page_id, digest FROM n""",
)
def candidate_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"{_CATEGORY.format('doc_id')} AS category", "doc_id % 1500 + 1 AS k", "text"
    )
    named = rows.select(
        curate.candidate_filename(
            F.col("category"), F.col("k"), F.col("doc_id"), dedupe.content_digest(F.col("text"))
        ).alias("filename")
    )
    page_id, digest = curate.parse_candidate_filename(F.col("filename"))
    return named.select("filename", page_id.alias("page_id"), digest.alias("digest"))


@curation.add(
    "manifest_rebuild",
    f"""
    WITH {_FLAT_CTE.strip()},
    f AS (
        SELECT doc_id AS page_id, max(path) AS path FROM (
            SELECT doc_id, 'pool/' || {_CATEGORY.format('doc_id')} || '/x_001_' || CAST(doc_id AS VARCHAR) || '_' || substr(sha256(text), 1, 12) || '.jpg' AS path FROM documents
            UNION ALL
            SELECT doc_id, 'pool/extra/y_' || CAST(doc_id AS VARCHAR) || '_' || substr(sha256(text), 1, 12) || '.jpg' FROM documents WHERE doc_id % 6 = 0) AS p
        GROUP BY 1)
    SELECT f.page_id, f.path, split_part(f.path, '/', 2) AS category, coalesce(title, '') AS title, coalesce(page_url, '') AS page_url,
           coalesce(original_url, '') AS original_url, coalesce(author, '') AS author, coalesce(license_name, '') AS license_name,
           coalesce(description, '') AS description
    FROM f LEFT JOIN flat ON flat.page_id = f.page_id""",
)
def manifest_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").selectExpr(
        "inline(array_compact(array("
        f"named_struct('path', concat('pool/', {_CATEGORY.format('doc_id')}, '/x_001_', CAST(doc_id AS STRING), '_', left(sha2(text, 256), 12), '.jpg')), "
        "IF(doc_id % 6 = 0, named_struct('path', concat('pool/extra/y_', CAST(doc_id AS STRING), '_', left(sha2(text, 256), 12), '.jpg')), NULL), "
        "named_struct('path', concat('pool/other/', CAST(doc_id AS STRING), '.jpg')))))"
    )
    return curate.rebuild_manifest(files, source.flatten_pages(_pages(spark, sf_dir)))


@curation.add(
    "first_wins_dedupe",
    """
    SELECT category, title, seq, doc_id, query FROM (
        SELECT doc_id % 3 AS category, text AS title, n_chars % 7 AS seq, doc_id, source AS query,
               row_number() OVER (PARTITION BY doc_id % 3, text ORDER BY n_chars % 7, doc_id) AS rn FROM documents) AS d
    WHERE rn = 1""",
)
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").selectExpr(
        "doc_id % 3 AS category", "text AS title", "n_chars % 7 AS seq", "doc_id",
        "source AS query",
    )
    return dedupe.first_wins(found, ["category", "title"], ["seq", "doc_id"])


# Images of 13 x 12 pixels are their own reduction, so that SQL can say their fingerprint.
_PICTURES = 15  # digests that hold the bytes of a picture
_DHASH_SQL = f"""
    WITH p AS (
        SELECT s_suppkey AS id, s_suppkey % 3 = 1 AS grey,
               string_agg(sha256(s_suppkey::VARCHAR || '-' || i::VARCHAR), '' ORDER BY i) AS h
        FROM supplier, range({_PICTURES}) AS r(i) GROUP BY 1),
    px AS (
        SELECT id, j, CASE WHEN grey THEN ('0x' || substr(h, 2 * j + 1, 2))::INT
               ELSE (('0x' || substr(h, 6 * j + 1, 2))::INT * 7471 + ('0x' || substr(h, 6 * j + 3, 2))::INT * 38470
                     + ('0x' || substr(h, 6 * j + 5, 2))::INT * 19595 + 32768) >> 16 END AS v
        FROM p, range(156) AS r(j)),
    bits AS (
        SELECT a.id, (a.j // 13) * 12 + a.j % 13 AS k, (a.v > b.v)::BIGINT AS bit
        FROM px AS a JOIN px AS b ON a.id = b.id AND b.j = a.j + 1 WHERE a.j % 13 < 12)
    SELECT id, sum(CASE WHEN k < 48 THEN bit << (47 - k) ELSE 0 END)::BIGINT AS w0,
           sum(CASE WHEN k BETWEEN 48 AND 95 THEN bit << (95 - k) ELSE 0 END)::BIGINT AS w1,
           sum(CASE WHEN k >= 96 THEN bit << (143 - k) ELSE 0 END)::BIGINT AS w2
    FROM bits GROUP BY id"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of 13 x 12 pixels for each supplier: grey or coloured, to be a PNG or BMP file."""
    digests = f"array_join(transform(sequence(0, {_PICTURES - 1}), i -> sha2(concat(s_suppkey, '-', i), 256)), '')"
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS STRING) AS name", "IF(s_suppkey % 3 = 2, 'bmp', 'png') AS format",
        "13 AS width", "12 AS height", "IF(s_suppkey % 3 = 1, 1, 3) AS channels",
        f"substring(unhex({digests}), 1, IF(s_suppkey % 3 = 1, 156, 468)) AS data",
    )


@curation.add("dhash_fingerprint", _DHASH_SQL)
def dhash_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of image files: written by tasks, read and decoded by the image source."""
    folder = skew.shared_folder(spark, "pictures")
    written = image_files.write_images(pictures(spark, sf_dir), folder)
    if written.agg(F.count("bytes")).first()[0] == 0:
        blocks = spark.createDataFrame([], "id long, width int, height int, channels int, data binary")
    else:
        blocks = image_files.read_images(spark, folder).withColumn("id", F.col("name").cast("long"))
    words = fingerprint.fingerprints(blocks)
    return words.select("id", *[F.get("words", F.lit(i)).alias(f"w{i}") for i in range(3)])
