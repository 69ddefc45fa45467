"""Readers on small literal inputs, and streams in several batches."""

import gzip

from pyspark.sql import functions as F

from haggleframe.sources import readers
from haggleframe.streaming import sightings


def test_indexes(spark, tmp_path):
    with gzip.open(tmp_path / "i.tsv.gz", "wt") as f:
        f.write("1\tAzul\t2017\t70\t90000\t7.7\tx\tAzul!\u001fAZUL\nshort\tline\n")
    row = readers.read_search_index(spark, str(tmp_path / "i.tsv.gz")).collect()
    assert len(row) == 1 and row[0].year == 2017 and row[0].geek is None and row[0].aliases == ["Azul!", "AZUL"]
    (tmp_path / "p.tsv").write_text("1\t900\t1200\n2\t700\n3\tbad\n")
    assert {tuple(r) for r in readers.read_price_index(spark, str(tmp_path / "p.tsv")).collect()} == {("1", 1200), ("2", 700)}


def test_xml(spark):
    good = '﻿<items><item id="7"><name type="primary" value="Azul"/><name type="alternate" value="A"/><yearpublished value="2017"/><link type="boardgamecategory" value="Abstract"/><link type="boardgamemechanic" value="Drafting"/></item></items>'
    bad = '<!DOCTYPE x [<!ENTITY e "v">]><items><item id="8"/></items>'
    rows = readers.catalogue_items(spark.createDataFrame([(good,), (bad,), ("<items>\x00</items>",)], "xml string")).collect()
    assert [(r.bgg_id, r.name, r.year, r.categories, r.mechanics) for r in rows] == [("7", "Azul", 2017, ["Abstract"], ["Drafting"])]


def test_embedded_json(spark):
    html = '<script>x = {"items": [{"id": 7, "title": "a } \\" b", "price": {"amount": "12.5"}, "user": {"id": 9}}, {"id": 7, "title": "again"}]}; y = "{}"</script><script>{"data": "{\\"id\\": 8, \\"title\\": \\"inner\\", \\"price\\": 3}"}</script>'
    got = {r.item_id: r for r in readers.embedded_items(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert set(got) == {"7", "8"} and got["8"].price == 3.0


def test_json_ld(spark):
    html = '<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Azul", "offers": [{"price": "20.5", "priceCurrency": "EUR"}]}]}</script><script type="application/ld+json">broken</script>'
    assert [tuple(r) for r in readers.product_data(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()] == [(1, "Azul", 20.5, "EUR")]


def test_cards(spark):
    cards = [("Azul, brand: Plan B, condizioni: Ottime, 12,50 €, 14,10 € incl., preferiti da 3 utenti",), ("senza prezzo",), (None,)]
    r = readers.parse_cards(spark.createDataFrame(cards, "card string")).collect()
    assert [(x.title, x.brand, x.condition, x.price_cents, x.protected_cents, x.favourites) for x in r] == [("Azul", "Plan B", "Ottime", 1250, 1410, 3)]


def test_item_links(spark):
    html = '<a href="/items/11-azul">Azul</a> 12,50 € <a href="/items/12-root">Root</a> none'
    assert {tuple(r) for r in readers.item_links(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()} == {(1, "11", 1250), (1, "12", None)}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([("q", 1, "a"), ("q", 2, None)], "query_key string, id long, t string")
    readers.write_snapshots(df, str(tmp_path / "s"))
    assert {tuple(r) for r in readers.read_snapshots(spark, str(tmp_path / "s"), "id long, t string, extra int").collect()} == {("q", 1, "a", None), ("q", 2, None, None)}


def test_stream_state_spans_batches(spark, tmp_path):
    schema = "event_id long, signature long, at timestamp, price_cents long"
    batches = [[(1, 5, 0, 100), (2, 5, 300, 100)], [(3, 5, 601, 90), (4, 5, 900, 90)]]
    for b in batches:
        rows = spark.createDataFrame(b, "event_id long, signature long, s long, price_cents long").select("event_id", "signature", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "price_cents")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    base = 1_700_000_000_000

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    assert sorted(drain(sightings.suppressed(source(), 600_000), "kept")) == [(5, base), (5, base + 601_000)]
    assert sorted(drain(sightings.price_changes(source()), "changed")) == [(5, base, 100), (5, base + 601_000, 90)]
    assert [r[1] for r in drain(sightings.running_listings(source()), "seen", "complete")] == [4]
    assert len(drain(sightings.once_within(source(), "1 hour"), "once")) == 4
    drain(sightings.session_windows(source(), 180_000), "sessions")


def test_titles_of_screens(spark):
    from haggleframe.functions import cards as c

    said = {
        "Azul, brand: Plan B, 12 €": "Azul", "12,50 € include la protezione; Azul gioco; Carcassonne il grande classico": "Carcassonne il grande classico", "9 €": "", "": "", "annuncio: Catan | 3 €": "Catan",
        "Brand: x, condizioni: y": "", "12345, 99 euro": "", "12 euro e 50, Root": "Root", "spedizione 3 €; x": "", "10 € Brass, bello": "Brass", "A" * 181 + ", ok": "ok",
    }
    got = c.with_title(spark.createDataFrame([(x,) for x in [*said, None]], "x string"), "x", "t").collect()
    assert {r.x: r.t for r in got} == {**said, None: ""}


def test_product_pages(spark):
    from haggleframe.functions import cards as c

    page = "<html><head><title>Azul - gioco da tavolo</title><script>12 €</script></head><body><!-- 1 € --><div>14,20 € con protezione</div><p>Prezzo&nbsp;13,50&nbsp;€</p><p>spedizione 2,99 €</p><li>Articolo non disponibile</li></body></html>"
    rows = c.product_pages(spark.createDataFrame([(1, page), (2, None), (3, "<p>Catan<br>5 &euro;</p>")], "page_id long, html string")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, "Azul - gioco da tavolo", 1350, 299, True), (2, "", None, None, False), (3, "Catan", 500, None, False)]


def test_very_long_json(spark):
    long = '<script>{"id": 7, "title": "' + "x" * 200_000 + '"}</script>'
    assert len(readers.embedded_items(spark.createDataFrame([(1, long)], "page_id long, html string")).first().title) == 200_000


def test_nearest_by_hamming(spark):
    import random

    from haggleframe.operators import hamming

    r = random.Random(3)
    rows = [(i, r.getrandbits(64) - (1 << 63)) for i in range(60)] + [(100, 5), (101, 5), (102, -1)]
    rows += [(200 + i, rows[i][1] ^ (1 << i)) for i in range(10)]
    asked = [(i, [h, r.getrandbits(63)]) for i, h in rows[:15]] + [(100, [5]), (500, [r.getrandbits(63)]), (501, [])]
    got = hamming.nearest(spark.createDataFrame(asked, "q long, hashes array<long>"), spark.createDataFrame(rows, "id long, hash long")).collect()
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {q: min((min(bits(h, x) for h in hs), i) for i, x in rows if i != q) for q, hs in asked if hs}
    assert {x.q: (x.distance, x.id) for x in got} == want
    assert hamming.nearest(spark.createDataFrame(asked[:1], "q long, hashes array<long>"), spark.createDataFrame(rows[:1], "id long, hash long")).count() == 0


def test_a_card_is_read_once(spark):
    """No condition on what is read from a card is moved below the reading and repeats it."""
    from haggleframe.plans.screens import card_records

    plan = card_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("regexp_instr") == 1
