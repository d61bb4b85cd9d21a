"""Scalar text functions as Column expressions (PR1-PR32)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# What exact copies may differ in.
REFERENCE = r"Reference ID [a-z0-9-]+"
NOISE = (
    "Warning: This page maybe requiring CAPTCHA, please make sure you are authorized to access this page.",
    "Trusted Editorial content, reviewed by leading industry experts and seasoned editors.",
    "Ad Disclosure",
)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """PR5: any white space, no-break space too, as one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def title_and_text(title: Column, text: Column) -> Column:
    return F.concat_ws("\n", title, text)


def drop_lines(c: Column, lines: Column) -> Column:
    """PR2: lines of over 15 characters, stripped, that the dictionary (an array) holds."""
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~((F.length(strip(x)) > 15) & F.array_contains(lines, strip(x)))), "\n")


def delete_phrases(c: Column, phrases: Iterable[str]) -> Column:
    """PR3: one after the other, so that a removal can make a later match."""
    return reduce(lambda x, p: F.replace(x, F.lit(p), F.lit("")), phrases, c)


def tokens(c: Column) -> Column:
    """PR6: Unicode words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def trigrams(words: Column) -> Column:
    """PR7: the words themselves if there are fewer than three."""
    slide = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.array_join(F.slice(words, i + 1, F.lit(3)), " "))
    return F.when(F.size(words) < 3, words).otherwise(slide)


def text_hash(c: Column) -> Column:
    return F.md5(F.lower(strip(c)))


def netloc(url: Column) -> Column:
    return F.parse_url(url, F.lit("AUTHORITY"))


def site_language(host: Column) -> Column:
    return F.when(host.contains(".ru") | host.contains("meduza"), "ru").otherwise("en")


ZONE = r"(?i)\s*(Z|[A-Z]{2,5}|(?:GMT|UTC)?\s*[+-]\d{2}:?\d{2})$"
#: Wall times that PR10 reads, after a weekday and the zone are off. ISO comes before them.
FORMATS = (
    "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy", "d MMMM yyyy HH:mm:ss", "d MMMM yyyy HH:mm", "d MMMM yyyy",
    "MMM d yyyy HH:mm:ss", "MMM d yyyy HH:mm", "MMM d yyyy", "MMMM d yyyy HH:mm:ss", "MMMM d yyyy HH:mm", "MMMM d yyyy",
    "MMM d HH:mm:ss yyyy", "yyyy/M/d HH:mm:ss", "yyyy/M/d", "M/d/yyyy HH:mm:ss", "M/d/yyyy", "yyyyMMdd",
)


def wall_and_zone(c: Column) -> tuple[Column, Column]:
    """The wall time that a date names, null where none is read, and its offset as +hh:mm: +00:00 where it has none or
    names one without figures."""
    c = F.trim(c)
    has_time = c.rlike(r"\d:\d{2}")
    zone = F.when(has_time, F.regexp_extract(c, ZONE, 1)).otherwise("")
    bare = F.when(has_time & (zone != ""), F.regexp_replace(c, ZONE, "")).otherwise(c)
    plain = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z]{3,9},? (?=\d{1,2} [A-Za-z]|[A-Za-z]{3,9} \d)", ""), ",", "")
    iso = F.when(bare.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(bare))
    wall = F.coalesce(iso, *[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS])
    figures = F.regexp_replace(F.regexp_extract(zone, r"([+-]\d{2}:?\d{2})$", 1), ":", "")
    return wall, F.when(figures == "", "+00:00").otherwise(F.concat(F.substring(figures, 1, 3), F.lit(":"), F.substring(figures, 4, 2)))


def fixed_date(c: Column) -> Column:
    """PR10: a date as ISO text with its own offset, UTC where it has none; what can't be read stays as it is. For a
    session in UTC."""
    wall, offset = wall_and_zone(c)
    micros = F.pmod(F.unix_micros(wall), F.lit(1_000_000))
    text = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), offset)
    return F.coalesce(text, c)


def flexible_date(c: Column) -> Column:
    """The instant of PR10's date; null where it can't be read. For a session in UTC."""
    wall, offset = wall_and_zone(c)
    minutes = (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")) * F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    return F.timestamp_micros(F.unix_micros(wall) - minutes.cast("long") * 60_000_000)


def made_up_title(title: Column, text: Column) -> Column:
    """PR12."""
    first = F.substring(F.split_part(text, F.lit(". "), F.lit(1)), 1, 100)
    made = F.when(F.coalesce(first, F.lit("")) != "", F.concat(first, F.lit("..."))).otherwise("News Article")
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(made)


def noise_key(c: Column, literals: Iterable[str] = NOISE) -> Column:
    """PR13: the key of exact copies."""
    return strip(delete_phrases(F.regexp_replace(c, REFERENCE, ""), literals))


def sentences(c: Column) -> Column:
    return F.split(c, r"(?U)(?<=[.!?])\s+")


def draw(*parts: Column | str) -> Column:
    """A reproducible random number of 32 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def mutate(c: Column, key: Column, seed: str = "42") -> Column:
    """PR15-17: sentences in a random order; of a single one with over three words, one word less."""
    parts, words = sentences(c), F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    keyed = F.transform(parts, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key, i.cast("string"))).alias("k"), i.alias("i"), x.alias("x")))
    shuffled = F.array_join(F.transform(F.array_sort(keyed), lambda s: s["x"]), " ")
    out = F.pmod(draw(F.lit(seed), key), F.size(words).cast("long"))
    fewer = F.array_join(F.filter(words, lambda x, i: i.cast("long") != out), " ")
    return F.when(c.isNull() | (c == ""), c).when(F.size(parts) > 1, shuffled).when(F.size(words) > 3, fewer).otherwise(c)


def copy_id(c: Column) -> Column:
    """PR18: of a null, null; a table's other identifier column is for the caller to fall back on."""
    return F.coalesce((c.try_cast("bigint") + 1000000).cast("string"), F.concat(c, F.lit("_dup")))


def is_original(c: Column) -> Column:
    """PR24."""
    return ~(F.endswith(c, F.lit("_dup")) | F.coalesce(c.try_cast("bigint") >= 1000000, F.lit(False)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def pair_text(title: Column, text: Column) -> Column:
    """PR26: nulls count as empty."""
    return F.concat(F.lit("TITLE: "), F.coalesce(title, F.lit("")), F.lit("\n\nCONTENT:\n"), F.coalesce(text, F.lit("")))


# The judge's instructions.
ASK = "You will evaluate pairs of news articles. For each pair, answer exactly '1' if they are about the EXACT SAME EVENT (duplicates/rewrites), or '0' if they are about DIFFERENT events (or one is a broad summary and the other is a specific event). Do not output anything else except a JSON array of integers: [1, 0, ...]\n\n"
ANSWER = ("Output ONLY a valid JSON array of integers with exactly ", " elements. Example: [1, 0, 1].")


def pair_prompt(pairs: Column) -> Column:
    """PR28: the question of a batch, from an array of (text_a, text_b) in order; each text is cut at 1500 characters."""

    def one(p: Column, i: Column) -> Column:
        side = lambda name, c: F.concat(F.lit(f"Article {name}:\n"), F.substring(c, 1, 1500), F.lit("...\n\n"))
        return F.concat(F.lit("--- PAIR "), i.cast("string"), F.lit(" ---\n"), side("A", p["text_a"]), side("B", p["text_b"]))

    return F.concat(F.lit(ASK), F.array_join(F.transform(pairs, one), ""), F.lit(ANSWER[0]), F.size(pairs).cast("string"), F.lit(ANSWER[1]))


def reply_labels(reply: Column, n: Column) -> Column:
    """PR27: a bracketed list of the right length, else loose 0s and 1s, else zeros."""
    listed = F.from_json(F.concat(F.lit("["), F.regexp_extract(F.coalesce(reply, F.lit("")), r"\[(.*?)\]", 1), F.lit("]")), "array<int>")
    loose = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"\b([01])\b"), F.lit(1)), lambda x: x.cast("int"))
    bracketed = F.coalesce(reply, F.lit("")).rlike(r"\[.*?\]")
    return F.when(bracketed & (F.size(listed) == n) & ~F.exists(listed, lambda x: x.isNull()), listed).when(F.size(loose) >= n, F.slice(loose, F.lit(1), n)).otherwise(F.array_repeat(F.lit(0), n))
