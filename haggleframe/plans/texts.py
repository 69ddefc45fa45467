"""Normalisation, classification, language, similarity and page extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from haggleframe.functions import classify, text
from haggleframe.operators import hamming, sequences
from haggleframe.plans.registry import query
from haggleframe.sources.market import games, listings, table, with_roles

_NORM = "trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def norm_sql(x: str) -> str:
    return _NORM.format(x=x)


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, length({norm_sql('text')}) AS n FROM documents")
def norm_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.normalise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", norm.alias("_norm")).select("doc_id", F.md5("_norm").alias("norm_md5"), F.length("_norm").cast("long").alias("n"))


_TITLES = "SELECT p_partkey AS game_id, concat(CASE p_partkey % 4 WHEN 0 THEN 'Gioco da tavolo ' WHEN 1 THEN 'Vendo ' WHEN 2 THEN 'edizione italiana ' ELSE '' END, p_name, CASE p_partkey % 3 WHEN 0 THEN ' come nuovo' WHEN 1 THEN ' nuovo completo' ELSE ' english' END) AS raw FROM part"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    lead = F.when(key % 4 == 0, "Gioco da tavolo ").when(key % 4 == 1, "Vendo ").when(key % 4 == 2, "edizione italiana ").otherwise("")
    tail = F.when(key % 3 == 0, " come nuovo").when(key % 3 == 1, " nuovo completo").otherwise(" english")
    return table(spark, sf_dir, "part").select(key.alias("game_id"), F.concat(lead, "p_name", tail).alias("raw"))


_STRIPPED = norm_sql("raw")
for _lead in text.LEADS:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_lead}', '')"
_STRIPPED = f"regexp_replace(regexp_replace({_STRIPPED}, '^{text.EDITION} ', ''), ' {text.EDITION}$', '')"
_STRIPPED = f"regexp_replace(regexp_replace({_STRIPPED}, '^(?:{text.CONDITION} )+', ''), '(?: {text.CONDITION})+$', '')"


@query(f"WITH t AS ({_TITLES}) SELECT game_id, {norm_sql('raw')} AS norm, {_STRIPPED} AS stripped FROM t")
def title_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _titles(spark, sf_dir).select("game_id", text.normalise(F.col("raw")).alias("norm"))
    return t.select("game_id", "norm", text.strip_noise(F.col("norm")).alias("stripped"))


def _any(norm: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({norm}, '{n}')" for n in needles) + ")"


def _phrase(norm: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(concat(' ', {norm}, ' '), ' {p} ')" for p in phrases) + ")"


@query(f"""WITH t AS (SELECT doc_id, {norm_sql('text')} AS x FROM documents) SELECT doc_id, CASE WHEN {_any('x', classify.NON_GAME)} OR {_any('x', classify.VIDEO_GAME)} OR {_phrase('x', ('cd', 'warhammer'))} THEN 'NON_GAME' WHEN {_any('x', classify.EMPTY_BOX)} THEN 'EMPTY_BOX'
    WHEN {_any('x', classify.ACCESSORY)} THEN 'ACCESSORY' WHEN {_any('x', classify.COMPONENTS)} THEN 'COMPONENTS' WHEN {_any('x', classify.BUNDLE)} THEN 'BUNDLE' WHEN {_any('x', classify.EXPANSION)} THEN 'EXPANSION' WHEN {_any('x', classify.BOX)} THEN 'UNCERTAIN' ELSE 'BASE_GAME' END AS kind FROM t""")
def listing_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("_x"))
    return t.select("doc_id", classify.listing_type(F.col("_x")).alias("kind"))


@query(f"""WITH t AS (SELECT conv_id, turn, {norm_sql('text')} AS x FROM conversations) SELECT conv_id, turn, coalesce({', '.join(f"CASE WHEN {_phrase('x', w)} THEN '{c}' END" for c, w in classify.LANGUAGES.items())}, '') AS language FROM t""")
def language_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalise(F.col("text")).alias("_x"))
    return t.select("conv_id", "turn", classify.stated_language(F.col("_x")).alias("language"))


_VOTES = " UNION ALL ".join(f"SELECT '{k}' AS lang, unnest({sorted(set(v.split()))}) AS word" for k, v in classify.VOCABULARY.items())


@query(f"""WITH v AS ({_VOTES}), t AS (SELECT doc_id, lang AS truth, {norm_sql('text')} AS x FROM documents), w AS (SELECT DISTINCT doc_id, unnest(string_split(x, ' ')) AS word FROM t),
    n AS (SELECT doc_id, lang, count(*) AS n FROM w JOIN v USING (word) GROUP BY ALL), f AS (SELECT t.doc_id, l.lang, coalesce(n.n, 0) AS n FROM t, (SELECT DISTINCT lang FROM v) l LEFT JOIN n ON n.doc_id = t.doc_id AND n.lang = l.lang),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang DESC) AS i, lead(n) OVER (PARTITION BY doc_id ORDER BY n DESC, lang DESC) AS second FROM f)
    SELECT t.doc_id, CASE WHEN r.n >= CASE WHEN length(x) >= 30 THEN 2 ELSE 3 END AND r.n > r.second THEN r.lang END AS voted, CAST(CASE WHEN r.n >= CASE WHEN length(x) >= 30 THEN 2 ELSE 3 END AND r.n > r.second AND r.lang = truth THEN 1 ELSE 0 END AS INTEGER) AS right_lang FROM t JOIN r ON r.doc_id = t.doc_id AND r.i = 1""")
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", "lang", text.normalise(F.col("text")).alias("_x"))
    voted = t.select("doc_id", "lang", classify.voted_language(F.split("_x", " "), F.length("_x")).alias("voted"))
    return voted.select("doc_id", "voted", F.coalesce((F.col("voted") == F.col("lang")).cast("int"), F.lit(0)).alias("right_lang"))


@query(r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(html, '&nbsp;', ' '), '&middot;', ' · '), '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_visible,
    len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS n_links FROM pages""")
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.visible_text(F.col("html"))).cast("long").alias("n_visible"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).cast("long").alias("n_links"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) SELECT page_id, link, count(*) AS n FROM l GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("link"))
    return l.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH b AS (SELECT item_id, list_distinct(string_split({norm_sql('text')}, ' ')) AS w FROM benchmark), d AS (SELECT doc_id, list_distinct(string_split({norm_sql('text')}, ' ')) AS w FROM documents),
    bt AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM b), dt AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM d),
    c AS (SELECT item_id, doc_id, bt.n AS bn, dt.n AS dn, count(*) AS common FROM bt JOIN dt USING (word) GROUP BY ALL)
    SELECT item_id, doc_id, round(common / (bn + dn - common), 9) AS jaccard, round(common / least(bn, dn), 9) AS containment FROM c WHERE common / bn >= 0.5""")
def passage_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least half of the words of a benchmark passage: an inverted-index join on the passage's rarest words.

    A document that lacks all of a passage's floor(n / 2) + 1 rarest words can't have half of its n words, so the common ones
    never meet. Texts are split once; words travel as 64-bit hashes.
    """
    words = lambda t, key: table(spark, sf_dir, t).select(key, F.transform(F.array_distinct(F.split(text.normalise(F.col("text")), " ")), lambda w: F.xxhash64(w)).alias(f"_{key}"))
    b, d = words("benchmark", "item_id"), words("documents", "doc_id")
    own = b.select("item_id", F.size("_item_id").alias("_size"), F.explode("_item_id").alias("word"))
    index = d.select("doc_id", F.explode("_doc_id").alias("word")).join(own.select("word").distinct(), "word", "left_semi")
    counts = index.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("item_id").orderBy(F.coalesce("_n", F.lit(0)), "word")
    rarest = own.join(counts, "word", "left").withColumn("_i", F.row_number().over(order)).filter("_i <= floor(_size / 2) + 1")
    pairs = rarest.select("item_id", "word").join(index, "word").select("item_id", "doc_id").distinct()
    x, y = F.col("_item_id"), F.col("_doc_id")
    kept = pairs.join(b, "item_id").join(d, "doc_id").filter(text.coverage(x, y) >= 0.5)
    return kept.select("item_id", "doc_id", F.round(text.jaccard(x, y), 9).alias("jaccard"), F.round(text.containment(x, y), 9).alias("containment"))


@query(with_roles("games") + f""", q AS (SELECT game_id, substr({norm_sql('name')}, 1, 6) AS q FROM games), k AS (SELECT DISTINCT {norm_sql('name')} AS t FROM games)
    SELECT game_id, count(*) AS hits, min(t) AS first_title FROM q JOIN k ON starts_with(t, q) GROUP BY game_id""")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that begin with a query: equi-join on prefixes of the query's length instead of comparing all pairs."""
    norm = text.normalise(F.col("name"))
    q = games(spark, sf_dir).select("game_id", F.substring(norm, 1, 6).alias("q"))
    k = games(spark, sf_dir).select(norm.alias("t")).distinct().withColumn("q", F.explode(F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.substring(F.col("t"), F.lit(1), n)))).distinct()
    return q.join(k, "q").groupBy("game_id").agg(F.count(F.lit(1)).alias("hits"), F.min("t").alias("first_title"))


@query(with_roles("games") + """, t AS (SELECT DISTINCT name FROM games), b AS (SELECT *, substr(lower(name), 1, 1) AS c, length(name) AS n FROM t)
    SELECT x.name AS name, y.name AS other, levenshtein(x.name, y.name) AS distance FROM b x JOIN b y ON x.c = y.c AND x.name <> y.name AND abs(x.n - y.n) <= 2 WHERE levenshtein(x.name, y.name) <= 3""")
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles at edit distance 3 or less: blocked by first letter and length, bounded distance."""
    t = games(spark, sf_dir).select("name").distinct().withColumns({"_c": F.lower(F.substring("name", 1, 1)), "_n": F.length("name")})
    near = t.withColumn("_n", F.explode(F.sequence(F.col("_n") - 2, F.col("_n") + 2))).withColumnRenamed("name", "other")
    d = F.levenshtein("name", "other", 3)
    return t.join(near, ["_c", "_n"]).filter((F.col("name") != F.col("other")) & (d >= 0)).select("name", "other", d.cast("long").alias("distance"))


@query(with_roles("games", "listings") + """, n AS (SELECT max(observed_ms) AS now FROM listings), a AS (SELECT listing_id, observed_ms, greatest(0, now - observed_ms) // 60000 AS m FROM listings, n)
    SELECT listing_id, CASE WHEN m < 1 THEN 'ora' WHEN m < 60 THEN concat(m, ' min') WHEN m // 60 < 24 THEN concat(m // 60, ' h') WHEN m // 1440 < 7 THEN concat(m // 1440, ' g') ELSE strftime(make_timestamp(observed_ms * 1000), '%d/%m') END AS age FROM a""")
def age_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = listings(spark, sf_dir)
    now = l.agg(F.max("observed_ms")).first()[0]
    return l.select("listing_id", text.age_label(F.col("observed_ms"), F.lit(now).cast("long")).alias("age"))


@query("""WITH h AS (SELECT vec_id, label, list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END))::BIGINT AS hash63 FROM embeddings), q AS (SELECT * FROM h WHERE vec_id % 100 = 0),
    p AS (SELECT q.vec_id, h.vec_id AS nearest, h.label AS found, q.label AS truth, bit_count(xor(q.hash63, h.hash63)) AS distance FROM q JOIN h ON h.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS i FROM p)
    SELECT vec_id, nearest, CAST(distance AS BIGINT) AS distance, CAST(CASE WHEN found = truth THEN 1 ELSE 0 END AS INTEGER) AS same_label FROM r WHERE i = 1""")
def photo_hash_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest photo hash of every hundredth photo (the query set) among all: the sign bits of 63 dimensions, by Hamming distance."""
    bits = F.aggregate(F.transform(F.slice("embedding", 1, 63), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    h = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", bits.alias("hash"))
    best = hamming.nearest(h.filter("id % 100 = 0").select(F.col("id").alias("q"), F.array("hash").alias("hashes")), h.select("id", "hash"))
    labels = h.select("id", "label")
    both = best.join(labels, "id").join(labels.toDF("q", "truth"), "q")
    return both.select(F.col("q").alias("vec_id"), F.col("id").alias("nearest"), F.col("distance").cast("long").alias("distance"), (F.col("label") == F.col("truth")).cast("int").alias("same_label"))


#: Shares of a photo's width that its crops keep, all about the middle, and where each crop is sampled: 65 places.
CROPS = (1.0, 0.92, 0.82, 0.72)
PLACES = [[int(32 * (1 - keep) + i * keep * 63 / 64) for i in range(65)] for keep in CROPS]
_BITS = lambda places: f"list_transform(range(64), lambda i: CASE WHEN embedding[({places})[i + 1] + 1] > embedding[({places})[i + 2] + 1] THEN 1 ELSE 0 END)"


@query(f"""WITH h AS (SELECT vec_id, {_BITS(PLACES[0])} AS full_, [{", ".join(map(_BITS, PLACES))}] AS crops FROM embeddings), q AS (SELECT vec_id, unnest(crops) AS crop FROM h WHERE vec_id % 100 = 0),
    p AS (SELECT q.vec_id, h.vec_id AS nearest, min(64 - list_sum(list_transform(list_zip(crop, full_), lambda x: CASE WHEN x[1] = x[2] THEN 1 ELSE 0 END))) AS distance FROM q JOIN h ON h.vec_id <> q.vec_id GROUP BY ALL)
    SELECT vec_id, nearest, CAST(distance AS BIGINT) AS distance, round(1 - distance / 64, 6)::DOUBLE AS likeness FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest) AS i FROM p) WHERE i = 1""")
def photo_crops_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest cover of every hundredth photo (the query set) by difference hashes: the whole photo or one of three crops against whole covers, the least distance counting."""
    def bit_hash(places: list[int]) -> Column:
        p = F.array(*map(F.lit, places))
        bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get("embedding", F.get(p, i)) > F.get("embedding", F.get(p, i + 1)), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.array(*map(bit_hash, PLACES)).alias("hashes"))
    best = hamming.nearest(queries, e.select(F.col("vec_id").alias("id"), bit_hash(PLACES[0]).alias("hash")))
    return best.select(F.col("q").alias("vec_id"), F.col("id").alias("nearest"), F.col("distance").cast("long").alias("distance"), F.round(1 - F.col("distance") / 64, 6).alias("likeness"))


@query(with_roles("games") + """, w AS (SELECT game_id, unnest(list_distinct(string_split(lower(name), ' '))) AS word FROM games), d AS (SELECT word, count(DISTINCT game_id) AS df FROM w GROUP BY word)
    SELECT word, df, round(least(5, 1 + ln(((SELECT count(*) FROM games) + 1) / (df + 1))), 9) AS idf FROM d""")
def word_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse document frequency of title words, at most 5."""
    g = games(spark, sf_dir)
    n = g.count()
    d = g.select("game_id", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("word")).groupBy("word").agg(F.count_distinct("game_id").alias("df"))
    return d.select("word", "df", F.round(F.least(F.lit(5.0), 1 + F.log((n + 1) / (F.col("df") + 1))), 9).alias("idf"))


@query(with_roles("games") + f""", q AS (SELECT game_id, {norm_sql('name')} AS q FROM games), t AS (SELECT {norm_sql('name')} AS t, count(*) AS n, min(game_id) AS id FROM games GROUP BY 1)
    SELECT q.game_id, CASE WHEN t.n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN t.n = 1 THEN t.id END AS match_id FROM q JOIN t ON t.t = q.q""")
def exact_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact match on the normalised name; a shared name stays ambiguous."""
    g = games(spark, sf_dir).select("game_id", text.normalise(F.col("name")).alias("_q"))
    t = g.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"), F.min("game_id").alias("_id"))
    one = F.col("_n") == 1
    return g.join(t, "_q").select("game_id", F.when(one, "matched").otherwise("ambiguous").alias("status"), F.when(one, F.col("_id")).alias("match_id"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, length(props) AS n FROM events""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON properties; missing ones are null."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("long").alias("n"))


def best_per_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.latest(listings(spark, sf_dir), ["game_id"], F.asc("price_cents"), F.asc("listing_id"))
