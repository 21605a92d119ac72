"""Exact Hamming near-duplicate search by banding.

Two fingerprints within `limit` bits agree on at least one of `limit + 1` disjoint bands, so equal
bands find every match. Bands are laid over informative bits only: bits that are the same in all rows
never differ and would only make bands that everything shares. Copies collapse to distinct
fingerprints first. A band value that is crowded on either side is split by a second level: inside it
the remaining bits again have `limit + 1` runs of which one must agree. Whatever is still crowded is
salted on the known side.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxlake import skew
from boxlake.operators.fingerprint import band_layout

BUCKET_LIMIT = 2_000
SALTS = 16


def hamming(a: Column, b: Column, words: int) -> Column:
    """Differing bits of two word arrays of known length."""
    counts = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(words)]
    return reduce(lambda x, y: x + y, counts)


def _bits(words: Column, start: int, length: int, word_bits: int) -> Column:
    """Bits [start, start + length) of the concatenated words as a string key."""
    parts = []
    at = start
    while at < start + length:
        word, low = divmod(at, word_bits)
        take = min(word_bits - low, start + length - at)
        shifted = F.shiftrightunsigned(F.get(words, F.lit(word)), low)
        parts.append(shifted.bitwiseAND(F.lit((1 << take) - 1)).cast("string"))
        at += take
    return F.concat_ws(":", *parts)


def _key(words: Column, bits: Sequence[int], word_bits: int) -> Column:
    """The listed bits (ascending) as one string key."""
    cuts = [i for i in range(1, len(bits)) if bits[i] != bits[i - 1] + 1]
    runs = [bits[i:j] for i, j in zip([0, *cuts], [*cuts, len(bits)], strict=True)]
    return F.concat_ws("|", *[_bits(words, r[0], len(r), word_bits) for r in runs])


def _split(bits: Sequence[int], parts: int) -> list[Sequence[int]]:
    return [bits[start : start + length] for start, length in band_layout(len(bits), parts)]


def informative_bits(rows: DataFrame, words: int, word_bits: int) -> list[int]:
    """Bit positions that are not the same in all rows: only they can differ between two rows, so
    only they tell rows apart. One aggregate without a shuffle of rows."""
    found = rows.agg(*[
        f(F.get("words", F.lit(i))).alias(f"{n}{i}")
        for i in range(words) for n, f in (("o", F.bit_or), ("a", F.bit_and))
    ]).first()
    if found["o0"] is None:
        return list(range(words * word_bits))
    return [
        i * word_bits + b for i in range(words) for b in range(word_bits)
        if (found[f"o{i}"] ^ found[f"a{i}"]) >> b & 1
    ]


def _banded(df: DataFrame, layout: Sequence[Sequence[int]], word_bits: int) -> DataFrame:
    keys = [
        F.struct(F.lit(i).alias("band"), _key(F.col("words"), bits, word_bits).alias("value"))
        for i, bits in enumerate(layout)
    ]
    return df.select("words", F.explode(F.array(*keys)).alias("k")).select("words", "k.*")


def _second_level(
    df: DataFrame, layout: Sequence[Sequence[int]], limit: int, word_bits: int
) -> DataFrame:
    """Rows of crowded buckets keyed by a run of the informative bits outside their band as well."""
    choices = None
    for band, own in enumerate(layout):
        rest = sorted(b for bits in layout for b in bits if bits is not own)
        runs = [
            F.struct(F.lit(j).alias("run"), _key(F.col("words"), bits, word_bits).alias("run_value"))
            for j, bits in enumerate(_split(rest, limit + 1))
        ]
        here = F.array(*runs)
        choices = (F if choices is None else choices).when(F.col("band") == band, here)
    return df.select("words", "band", "value", F.explode(choices).alias("r")).select(
        "words", "band", "value", "r.*"
    )


def near_matches(
    candidates: DataFrame, known: DataFrame, words: int, word_bits: int, limit: int = 5,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """Distinct candidate fingerprints within `limit` bits of any known one."""
    mine, other = candidates.select("words").distinct(), known.select("words").distinct()
    bits = informative_bits(
        candidates.select("words").unionByName(known.select("words")), words, word_bits
    )
    if len(bits) <= limit:
        # No two rows differ in more bits than that: every candidate is near any known row.
        return mine.join(F.broadcast(known.limit(1).select(F.lit(True).alias("_any"))))[["words"]]
    layout = _split(bits, limit + 1)
    ours = _banded(mine, layout, word_bits)
    theirs = _banded(other, layout, word_bits).withColumnRenamed("words", "known_words")
    close = hamming(F.col("words"), F.col("known_words"), words) <= limit
    keys = ["band", "value"]
    # A bucket is crowded if either side is; with few bits left a second level has nothing to add.
    crowded = None
    if len(bits) - max(map(len, layout)) > limit:
        sides = [skew.hot_groups(side, keys, bucket_limit) for side in (ours, theirs)]
        sides = [side.select(*keys) for side in sides if side is not None]
        crowded = sides[0] if sides else None
        if len(sides) == 2:
            crowded = sides[0].unionByName(sides[1]).distinct()
    if crowded is None:
        found = ours.join(theirs, keys).filter(close)
        return found.select("words").distinct()
    crowded = skew.sized_broadcast(crowded)
    calm = ours.join(crowded, keys, "left_anti").join(theirs, keys).filter(close)
    hot_ours = _second_level(ours.join(crowded, keys, "left_semi"), layout, limit, word_bits)
    hot_theirs = _second_level(
        theirs.join(crowded, keys, "left_semi").withColumnRenamed("known_words", "words"),
        layout, limit, word_bits,
    ).withColumnRenamed("words", "known_words")
    salted_theirs = hot_theirs.withColumn(
        "salt", F.pmod(F.xxhash64("known_words"), F.lit(SALTS)).cast("int")
    )
    salted_ours = hot_ours.withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    )
    hot = salted_ours.join(
        salted_theirs, [*keys, "run", "run_value", "salt"]
    ).filter(close)
    return calm.select("words").unionByName(hot.select("words")).distinct()


def flag_near_duplicates(
    candidates: DataFrame, known: DataFrame, words: int, word_bits: int, limit: int = 5,
    salt_on: str = "id", name: str = "near_duplicate", **options,
) -> DataFrame:
    """All candidates with a flag: within `limit` bits of a known fingerprint or not."""
    matches = near_matches(candidates, known, words, word_bits, limit, **options)
    flagged = skew.skew_join(
        candidates, matches.withColumn("_hit", F.lit(True)), ["words"], "left", [salt_on]
    )
    return flagged.withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_hit")
