"""What brings an offer to the top for a buyer who reads Italian, and small classifiers of titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from haggleframe.functions.text import jaccard, normalise, strip_accents

#: Points of each decision.
PRIORITY = {"GREAT_BUY": 5, "GOOD_PRICE": 4, "OFFER": 3, "FAIR": 2, "INSUFFICIENT_DATA": 1}
#: Languages that the buyer doesn't read.
FOREIGN = r"^(FR|DE|ES|NL|PT)"
#: Accessories, parts and lots in the titles of sellers of several countries.
ACCESSORY = (
    r"\b(accessoires|accessori|accessorio|organiseur|organizzatore|organizer|organiser|jetons|tokens?|voedseltokens|dobbelhuisje|voedselhuisje|voedselbakjes|inlay|inserto|insert|componenti|ricambio|ricambi|"
    r"vuot[aeio]|empty|leer|lege|sleeves|bustine|fanmade|playmat|pedine|segnalini|zubehor|ersatzteile|hulle|nintendo|casco|casque)\b"
)
PARTS = (
    r"\b(errata\s*(?:pack|kit)?|correction\s*(?:pack|kit)|backup\s+(?:pieces?|parts?|components?|tokens?|cards?)|replacement\s+(?:pieces?|parts?|components?|tokens?|cards?)|spare\s+(?:pieces?|parts?|components?|tokens?|cards?)|"
    r"pezzi\s+di\s+ricambio|componenti\s+di\s+ricambio|solo\s+(?:scatola|box|manuale|regolamento)|box\s+only|rulebook\s+only|manual\s+only)\b"
)
LOTS = r"\b(bundle|lotto|lotti|lot|paket)\b"
#: Words that mark another variant of a game, and words that a short query leaves out.
MARKERS = (" duo ", " junior ", " legacy ", " duel ", " big box ", " pocket ", " mini ", " travel ", " viaggio ", " espansione ", " expansion ", " erweiterung ", " standalone ", " sequel ")
GENERIC = "gioco giochi tavolo boardgame board game italiano italiana nuovo nuova ottime condizioni carte imbustate completo completa"


def folded(x: Column) -> Column:
    """Normalised after a possessive s is dropped with its apostrophe."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(F.coalesce(x, F.lit("")))), r"\b([a-z0-9]+)[’']s\b", "$1"), "[^a-z0-9]+", " "))


def title_kind(norm: Column) -> Column:
    """unknown for an empty title, else accessory, bundle or game_candidate; from a folded title."""
    return F.when(norm == "", "unknown").when(norm.rlike(ACCESSORY) | norm.rlike(PARTS), "accessory").when(norm.rlike(LOTS), "bundle").otherwise("game_candidate")


def names_variant(current: Column, title: Column, details: Column) -> Column:
    """Whether normalised texts speak of a variant of the current game: a marker, and a word of three letters or more of its name."""
    whole = F.concat(F.lit(" "), title, F.lit(" "), details, F.lit(" "))
    marked = F.exists(F.array(*map(F.lit, MARKERS)), lambda m: whole.contains(m))
    return marked & F.exists(F.split(current, " "), lambda w: (F.length(w) >= 3) & whole.contains(F.concat(F.lit(" "), w, F.lit(" "))))


def compact_query(norm: Column, most: int = 5) -> Column:
    """The first few words of a normalised title that have two letters or more and aren't generic: what is asked of a search engine."""
    fixed = F.array(*map(F.lit, GENERIC.split()))
    return F.array_join(F.slice(F.filter(F.split(norm, " "), lambda w: (F.length(w) >= 2) & ~F.array_contains(fixed, w)), 1, most), " ")


def packed_list(raw: Column) -> Column:
    """The distinct entries of a list that is packed as JSON, by commas, bars or dots; a null list has none."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[\[\]\"]", ""), r"[|,]", " · ")
    return F.array_distinct(F.filter(F.transform(F.split(plain, " · "), F.trim), lambda x: x != ""))


def resale_worthy(shipping_verified: Column, saving: Column) -> Column:
    """Shipping is known and at least two fifths are saved."""
    return F.coalesce(shipping_verified.isNotNull() & (saving >= 40), F.lit(False))


def relevance(decision: Column, quality: Column, saving: Column, rating: Column, age_ms: Column, shipping_verified: Column, language: Column, linked: Column, bundled: Column, owned: Column) -> Column:
    """Composite score: the decision above all, then quality, saving, rating and freshness; what eases buying counts for it, a foreign or unknown language and a second copy against it."""
    code = F.upper(F.coalesce(language, F.lit("")))
    foreign, bound, free = code.rlike(FOREIGN), code.contains("DEP"), code.contains("IND")
    points = F.coalesce(*[F.when(decision == k, v) for k, v in PRIORITY.items()], F.lit(0))
    deal = F.when(saving.isNull(), 0.0).otherwise(F.greatest(F.lit(-15.0), F.least(F.lit(35.0), saving.cast("double"))))
    fresh = F.greatest(F.lit(0.0), 18 - age_ms / 3_600_000.0)
    gains = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    ease = gains(shipping_verified <= 300, 10) + gains(code.startswith("IT") | free, 6) + gains(linked, 5) + gains(bundled, 14)
    penalty = F.when(foreign & bound, 260).when(foreign & ~free, 55).when((code == "") | (~bound & ~free), 18).otherwise(0)
    twice = gains(owned & ~resale_worthy(shipping_verified, saving), 90)
    return points * 42 + F.coalesce(quality, F.lit(50)) * 0.24 + deal * 0.10 + F.coalesce(rating, F.lit(6.0)) * 3.0 + fresh * 0.35 + ease - penalty - twice


def snapshot_score(observed: Column, candidate: Column, diff: Column, brand: Column, given: Column) -> Column:
    """Points of a cached candidate by normalised titles, difference in cents and brands; 0 if title or price rule it out."""
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    j = jaccard(words(observed), words(candidate))
    title = F.when(observed == candidate, 60).when(j >= 0.92, 50).when(j >= 0.82, 40).when(j >= 0.68, 26)
    price = F.when(diff <= 1, 32).when(diff <= 5, 26).when(diff <= 20, 10)
    b = jaccard(words(normalise(brand)), words(normalise(given)))
    named = (F.coalesce(brand, F.lit("")) != "") & (F.coalesce(given, F.lit("")) != "")
    return F.coalesce(title + price + F.when(named & (b >= 0.9), 14).when(named & (b >= 0.62), 6).otherwise(0), F.lit(0))
