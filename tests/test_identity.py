"""Identities, gates and candidate generation on small fixtures."""

from haggleframe.plans import identity


def test_identify_goes_through_its_steps(spark):
    catalogue = spark.createDataFrame([(1, "carcassonne"), (2, "wingspan"), (3, "terraforming mars"), (4, "azul"), (5, "azul"), (6, "mars attacks")], "game_id long, title string")
    asked = spark.createDataFrame([("carcassonne",), ("wingspan gioco bello",), ("azul",), ("terraforming marz",), ("qqqq zzzz",), ("old name",)], "asked string")
    aliases = spark.createDataFrame([("old name", 2)], "asked string, alias_id long")
    out = {r["asked"]: (r["game_id"], r["step"]) for r in identity.identify(asked, catalogue, aliases).collect()}
    assert len(out) == 6
    assert out["carcassonne"] == (1, "exact")
    assert out["azul"] == (None, "review")  # two games share the title
    assert out["old name"] == (2, "alias")
    assert out["qqqq zzzz"] == (None, "quarantine")
    assert out["terraforming marz"][1] in ("fuzzy", "review") and out["terraforming marz"][0] in (3, None)


def test_identify_of_empty_tables(spark):
    empty = spark.createDataFrame([], "game_id long, title string")
    out = identity.identify(spark.createDataFrame([("azul",)], "asked string"), empty, spark.createDataFrame([], "asked string, alias_id long")).collect()
    assert [tuple(r) for r in out] == [("azul", None, "quarantine")]


def test_identity_pipeline_resolves_the_catalogue(spark):
    sf = "/root/testdata/sf0.001"
    rows = identity.identity_pipeline(spark, sf).collect()
    assert len({r["asked"] for r in rows}) == len(rows) > 0
    assert all((r["game_id"] is None) == (r["step"] in ("review", "quarantine")) for r in rows)


def test_candidates_need_one_of_the_three_rarest_tokens(spark):
    titles = spark.createDataFrame([("red game of ants",), ("game of bees",), ("game of cats and dogs",), ("the game",)], "title string")
    asked = spark.createDataFrame([("game cats dogs and ants",), ("of",), ("",)], "asked string")
    found = {(r["asked"], r["title"]) for r in identity.rarest_token_candidates(asked, titles).collect()}
    assert found == {("game cats dogs and ants", "game of cats and dogs"), ("game cats dogs and ants", "red game of ants")}


def test_rating_gate(spark):
    games = [(1, 5.90, True, None), (2, 5.99, True, None), (3, 6.00, True, None), (4, 7.20, False, "RATING_BELOW_6"), (5, 4.80, False, "USER_NOT_A_BOARD_GAME"), (6, None, False, "RATING_BELOW_6"), (7, None, True, None)]
    before = spark.createDataFrame(games, "game_id int, rating double, visible boolean, reason string")
    after = identity.rating_gate(before)
    got = {r["game_id"]: (r["visible"], r["reason"]) for r in after.collect()}
    assert got == {1: (False, "RATING_BELOW_6"), 2: (False, "RATING_BELOW_6"), 3: (True, None), 4: (True, None), 5: (False, "USER_NOT_A_BOARD_GAME"), 6: (False, "RATING_BELOW_6"), 7: (True, None)}
    assert sorted(map(repr, identity.rating_gate(after).collect())) == sorted(map(repr, after.collect()))  # once more changes nothing
    assert sorted(map(repr, identity.rating_gate(before, swept=True).collect())) == sorted(map(repr, before.collect()))


def test_publishers(spark):
    pairs = [("Days of Wonder", "Days of Wonder Games", True), ("Giochi Uniti", "giochi uniti edizioni", True), ("Games", "Games", False), ("Asmodee", None, False), ("Kosmos", "Ravensburger", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r[0] for r in df.select(identity.same_publisher(df.a, df.b)).collect()] == [x for *_, x in pairs]
