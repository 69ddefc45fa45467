"""Text normalisation, similarity and extraction as column expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@functools.cache
def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks and the base letter of each: every decomposition there has a single base."""
    pairs = []
    for block in (range(0xA0, 0x250), range(0x1E00, 0x1F00)):
        for c in map(chr, block):
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
            if bare != c and len(bare) == 1:
                pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, *_accents()), r"\p{M}+", "")


def normalise(x: Column) -> Column:
    """Without accents, lower case, every run of anything but a-z and 0-9 as one blank; null is empty."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(x, F.lit("")))), "[^a-z0-9]+", " "))


def normalise_letters(x: Column) -> Column:
    """The same, but letters and digits of all scripts stay."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def meaningful(norm: Column, fillers: tuple[str, ...], least: int = 2) -> Column:
    words = F.array(*map(F.lit, fillers))
    return F.filter(F.split(norm, " "), lambda w: (F.length(w) >= least) & ~F.array_contains(words, w))


def has_phrase(norm: Column, *phrases: str) -> Column:
    """Whether any phrase occurs as whole words."""
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | padded.contains(f" {p} ")
    return out


def has_text(norm: Column, *needles: str) -> Column:
    """Whether any needle occurs, inside words too."""
    out = F.lit(False)
    for n in needles:
        out = out | norm.contains(n)
    return out


#: Words around a title that say how and in which language a thing is sold.
EDITION = "(?:edizione )?(?:italiano|italiana|italian|inglese|english|francese|french|tedesco|tedesca|german|deutsch|spagnolo|spagnola|spanish|olandese|dutch|portoghese|portuguese)"
CONDITION = "(?:completo di tutto|ottime condizioni|perfette condizioni|come nuovo|come nuova|sigillato|sigillata|sealed|completo|completa|nuovo|nuova|new|usato|usata|used)"
LEADS = ("^(?:il |lo |la |un |una )?(?:gioco da tavolo|gioco di societa|board game|tabletop game) ", "^(?:vendo gioco|vendesi|vendo|gioco) ")


def strip_noise(norm: Column) -> Column:
    """A normalised title without category, language and condition words at its edges."""
    for lead in LEADS:
        norm = F.regexp_replace(norm, lead, "")
    norm = F.regexp_replace(F.regexp_replace(norm, f"^{EDITION} ", ""), f" {EDITION}$", "")
    return F.regexp_replace(F.regexp_replace(norm, f"^(?:{CONDITION} )+", ""), f"(?: {CONDITION})+$", "")


#: What is between a title and a seller's words about it, and what those words contain.
DASHES = r" (?:–|—|-) "
DESCRIBES = ("gioco ", " gioco", "board game", "edizione", "versione", "marca ", "condizioni", "completo", "sigillato")


def descriptive_lead(raw: Column) -> Column:
    """What stands before the first dash, if it has a letter or two and words behind the dash describe the thing; else empty."""
    x = F.coalesce(raw, F.lit(""))
    lead = F.regexp_extract(x, f"(?s)^(.{{2,}}?){DASHES}", 1)
    rest = normalise(F.substring(x, F.length(lead) + 2, F.length(x)))
    return F.when((lead != "") & has_text(rest, *DESCRIBES), F.trim(lead)).otherwise("")


def with_title_variants(rows: DataFrame, title: str, into: str) -> DataFrame:
    """Add the distinct non-empty spellings to look up, in order: the title, without noise, what leads it, and that without noise."""
    parts = rows.withColumns({"_base": normalise(F.col(title)), "_lead": normalise(descriptive_lead(F.col(title)))})
    short = parts.withColumns({"_short": strip_noise(F.col("_base")), "_short_lead": strip_noise(F.col("_lead"))})
    return short.withColumn(into, F.array_remove(F.array_distinct(F.array("_base", "_short", "_lead", "_short_lead")), "")).drop("_base", "_lead", "_short", "_short_lead")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that both have."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(0.0)


def coverage(required: Column, candidate: Column) -> Column:
    """Share of the required tokens that the candidate has."""
    return F.when(F.size(required) > 0, F.size(F.array_intersect(required, candidate)) / F.size(F.array_distinct(required))).otherwise(0.0)


def search_score(query: Column, title: Column) -> Column:
    """How well a normalised title answers a normalised query: 1000 if equal, else the mean of the words' best matches."""
    wanted, words = F.split(query, " "), F.split(title, " ")

    def best(w: Column) -> Column:
        def one(v: Column) -> Column:
            d = F.levenshtein(w, v)
            near = (F.length(w) >= 4) & (F.abs(F.length(w) - F.length(v)) <= 2) & (d <= F.greatest(F.lit(1), F.floor(F.length(w) / 5)))
            return F.when(w == v, 100).when((F.length(w) >= 3) & v.startswith(w), 80).when(near, 70 - d * 10).otherwise(0)

        return F.array_max(F.transform(words, one))

    total = F.aggregate(F.transform(wanted, best), F.lit(0), lambda acc, x: acc + x)
    score = F.floor(total / F.size(wanted)).cast("int") * 8 - F.abs(F.size(words) - F.size(wanted)) * 8
    return F.when((query == "") | (title == ""), 0).when(query == title, 1000).otherwise(score)


def popularity_boost(rank: Column, voters: Column) -> Column:
    by_rank = F.when(rank <= 0, 0).when(rank <= 100, 110).when(rank <= 500, 80).when(rank <= 2000, 45).when(rank <= 10000, 18).otherwise(0)
    by_votes = F.when(voters >= 20000, 55).when(voters >= 5000, 35).when(voters >= 1000, 18).otherwise(0)
    return by_rank + by_votes


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, tags and the commonest entities."""
    x = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style\b[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(x, F.lit("&nbsp;"), F.lit(" ")), F.lit("&middot;"), F.lit(" · ")), r"\s+", " "))


def age_label(at_ms: Column, now_ms: Column) -> Column:
    """Short age: now, minutes, hours, days up to a week, then the day and month."""
    m = F.floor(F.greatest(F.lit(0).cast("long"), now_ms - at_ms) / 60000)
    h, d = F.floor(m / 60), F.floor(m / 1440)
    date = F.date_format(F.timestamp_millis(at_ms), "dd/MM")
    return F.when(m < 1, "ora").when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(h < 24, F.concat(h.cast("string"), F.lit(" h"))).when(d < 7, F.concat(d.cast("string"), F.lit(" g"))).otherwise(date)


def photo_key(url: Column) -> Column:
    """What identifies a photo whatever its size: the path part before the size folder."""
    return F.regexp_extract(url, r"/t/([^/]+)/", 1)


def gtin_is_valid(digits: Column) -> Column:
    """Checksum of an 8 to 14 digit trade number: alternating weights 3 and 1 from the right."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    total = F.aggregate(F.transform(d, lambda x, i: x * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda acc, x: acc + x)
    return digits.rlike(r"^(\d{8}|\d{12,14})$") & (total % 10 == 0)
