"""Hand-made matches through the sources and derivations; invariants; scopes; text; guarded SQL; streams."""

import json

import pytest
from pyspark.sql import functions as F

from tallyline.functions import flags, scope
from tallyline.functions.metrics import REGISTRY, get, search
from tallyline.functions.text import norm
from tallyline.operators import ballstats, curation, derive, engine, insights, models, resolve, results, study
from tallyline.plans import ledger
from tallyline.sources import matches as sources
from tallyline.sources import pages, sqlguard
from tallyline.sources.stored import Stored
from tallyline.streaming import feeds


def ball(batter, bowler, runs=0, other="Oak", extras=None, wickets=None, non_boundary=None):
    e = extras or {}
    r = {"batter": runs, "extras": sum(e.values()), "total": runs + sum(e.values())}
    if non_boundary:
        r["non_boundary"] = True
    d = {"batter": batter, "bowler": bowler, "non_striker": other, "runs": r}
    return d | ({"extras": e} if e else {}) | ({"wickets": wickets} if wickets else {})


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    over = [
        ball("Ash", "Elm", 4), ball("Ash", "Elm", 0, extras={"wides": 1}), ball("Ash", "Elm", 1, extras={"noballs": 1, "byes": 2}), ball("Ash", "Elm", 6, non_boundary=True),
        ball("Ash", "Elm", wickets=[{"kind": "run out", "player_out": "Oak", "fielders": [{"name": "Yew"}]}]), ball("Ash", "Elm", extras={"legbyes": 1}, other="Fir"),
        ball("Ash", "Elm", wickets=[{"kind": "retired hurt", "player_out": "Ash"}], other="Fir"), ball("Fir", "Elm", wickets=[{"kind": "caught and bowled", "player_out": "Fir"}], other="Bay"),
    ]
    maiden = [ball("Bay", "Yew", other="Gum") for _ in range(6)]
    stumped = [ball("Bay", "Yew", other="Gum", wickets=[{"kind": "stumped", "player_out": "Bay", "fielders": [{"name": "Elm"}]}])]
    reply = [ball("Elm", "Ash", 1, other="Yew", extras={"penalty": 5}), ball("Yew", "Ash", other="Elm", wickets=[{"kind": "caught", "player_out": "Yew", "fielders": [{"name": "Oak"}]}, {"kind": "run out", "player_out": "Elm"}])]
    super_over = [ball("Ash", "Elm", 6)]
    d = {
        "meta": {"data_version": "1.1"},
        "info": {"match_type": "T20", "gender": "female", "team_type": "club", "dates": ["2024-03-01"], "venue": "The Green, Town", "season": "2023/24", "teams": ["Trees", "Shrubs"], "toss": {"winner": "Trees", "decision": "bat"},
                 "outcome": {"winner": "Trees", "by": {"runs": 5}}, "players": {"Trees": ["Ash", "Oak", "Fir", "Bay", "Gum"], "Shrubs": ["Elm", "Yew"]}, "registry": {"people": {"Ash": "a1"}}},
        "innings": [{"team": "Trees", "overs": [{"over": 0, "deliveries": over}, {"over": 1, "deliveries": maiden + stumped}]}, {"team": "Shrubs", "overs": [{"over": 0, "deliveries": reply}]}, {"team": "Trees", "super_over": True, "overs": [{"over": 0, "deliveries": super_over}]}],
    }
    path = tmp_path_factory.mktemp("matches")
    (path / "deep").mkdir()
    (path / "deep" / "m1.json").write_text(json.dumps(d))
    (path / "bad.json").write_text("{not json")
    import zipfile

    with zipfile.ZipFile(path / "all.zip", "w") as z:
        z.writestr("m1.json", json.dumps(d))
    return sources.documents(spark, str(path)), sources.zipped(spark, f"{path}/all.zip")


@pytest.fixture(scope="module")
def tables(docs):
    d = docs[0]
    keepers = derive.keepers(sources.players(d), sources.wickets(d))
    balls = derive.with_keeper_catches(derive.flag(sources.deliveries(d), sources.matches(d)), keepers)
    return derive.build(balls) | {"balls": balls, "keepers": keepers}


def rows(df, key):
    return {r[key]: r for r in df.collect()}


def test_sources_flatten_and_agree(docs):
    folder, archive = docs
    assert sources.deliveries(folder).count() == 18 and sources.wickets(folder).count() == 6
    assert sources.deliveries(folder).exceptAll(sources.deliveries(archive)).count() == 0
    m = sources.matches(folder).first()
    assert (m.winner, m.win_by_runs, m.date, m.data_version) == ("Trees", 5, "2024-03-01", "1.1")
    assert rows(sources.players(folder), "player")["Ash"].player_id == "a1"


def test_scoring_rules(tables):
    bat = rows(tables["batting_innings"].filter("innings = 1"), "player")
    assert (bat["Ash"].balls, bat["Ash"].runs, bat["Ash"].out, bat["Ash"].fours, bat["Ash"].sixes) == (6, 11, 0, 1, 0)
    assert (bat["Oak"].balls, bat["Oak"].out, bat["Oak"].kind) == (0, 1, "run out")
    assert bat["Gum"].balls == 0 and bat["Gum"].out == 0 and [bat[p].position for p in ("Ash", "Oak", "Fir", "Bay", "Gum")] == [1, 2, 3, 4, 5]
    bowl = rows(tables["bowling_innings"].filter("innings = 1"), "player")
    assert (bowl["Elm"].deliveries, bowl["Elm"].balls, bowl["Elm"].runs, bowl["Elm"].wickets) == (8, 6, 13, 1)
    assert (bowl["Yew"].maidens, bowl["Yew"].wickets, bowl["Yew"].team, bowl["Yew"].result) == (1, 1, "Shrubs", "lost")
    reply = rows(tables["bowling_innings"].filter("innings = 2"), "player")
    assert (reply["Ash"].runs, reply["Ash"].wickets, reply["Ash"].n_run_out) == (1, 1, 1)
    out = rows(tables["batting_innings"].filter("innings = 2"), "player")  # two wickets on one ball
    assert {p: (out[p].out, out[p].kind) for p in ("Yew", "Elm")} == {"Yew": (1, "caught"), "Elm": (1, "run out")}
    assert rows(tables["batting_phase"].filter("innings = 2"), "player")["Elm"].out == 1
    assert tables["states"].filter("innings = 2").agg(F.sum("outs"), F.max("wkts")).first() == (2, 0)
    assert insights.conserved(tables["balls"], tables["batting_innings"]).filter("not ok").count() == 0
    assert tables["balls"].filter("innings = 3").count() == 0
    assert rows(tables["keepers"], "team")["Shrubs"].keeper == "Elm"


def test_names_become_persons_everywhere(docs, spark):
    d = docs[0]
    register_ = spark.createDataFrame([("a1", "Ash the Elder")], "identifier string, unique_name string")
    balls = derive.with_persons(derive.flag(sources.deliveries(d), sources.matches(d)), derive.identities(sources.players(d), register_))
    bat = rows(derive.build(balls)["batting_innings"].filter("innings = 1"), "player")
    assert "Ash" not in bat and (bat["Ash the Elder"].runs, bat["Ash the Elder"].balls) == (11, 6) and bat["Oak"].out == 1
    assert rows(derive.bowling_innings(derive.build(balls)["states"]).filter("innings = 2"), "player")["Ash the Elder"].wickets == 1


def test_drawn_tied_and_no_result_are_told_apart(docs):
    m, d = sources.matches(docs[0]), sources.deliveries(docs[0])
    for kind, word in (("draw", "drawn"), ("tie", "tied"), ("no result", "no result"), (None, "no result")):
        open_ = m.withColumns({"winner": F.lit(None).cast("string"), "result_type": F.lit(kind)})
        assert {r.result for r in derive.flag(d, open_).select("result").distinct().collect()} == {word}
        assert scope.build("batting", result=word).apply(derive.flag(d, open_)).count() == 17


def test_old_tables_have_one_wicket_on_a_ball(docs):
    d = sources.deliveries(docs[0])
    old = d.withColumns({"kind": F.get("wickets", F.lit(0))["kind"], "player_out": F.get("wickets", F.lit(0))["player_out"]}).drop("wickets")
    got = derive.flag(old, sources.matches(docs[0])).agg(F.sum("outs"), F.sum("credited")).first()
    assert tuple(got) == (4, 3)


def test_expected_adds_up(tables):
    s = tables["states"].filter("faced").agg(F.sum("runs_batter"), F.sum("e_runs")).first()
    assert s[0] == pytest.approx(s[1])
    assert insights.zero_sum(tables["batting_innings"]).filter("not ok").count() == 0


def test_figures_from_balls(tables, docs):
    bat = rows(ballstats.batting(tables["balls"].filter("innings = 1")), "player")
    assert (bat["Ash"].runs, bat["Ash"].not_outs, bat["Gum"].innings) == (11, 1, 1)
    reply = rows(ballstats.batting(tables["balls"].filter("innings = 2")), "player")
    assert (reply["Elm"].not_outs, reply["Yew"].not_outs) == (0, 0)
    assert rows(ballstats.innings_totals(tables["balls"]), "innings")[2].wickets == 2
    field = rows(ballstats.fielding(sources.wickets(docs[0])), "player")
    assert field["Elm"].catches == 1 and field["Elm"].stumpings == 1 and field["Oak"].catches == 1


def test_every_metric_in_every_shape(spark, tables):
    for role, ms in REGISTRY.items():
        df = derive.constant_k(tables[f"{role}_innings"], role, 100.0)
        out = df.groupBy("player").agg(*(m.column() for m in ms.values())).collect()
        assert out and len(out[0]) == len(ms) + 1
        phase = tables[f"{role}_phase"]
        phase.groupBy("player").agg(*(m.column() for m in ms.values() if m.phase)).collect()
    assert get("batting", "highest").kind == "text" and {m.id for m in search("regressed average")} == {"regressed_average"}
    assert len(REGISTRY["batting"]) == 47 and len(REGISTRY["bowling"]) == 38


def test_shrinkage_limits(tables):
    base = tables["batting_innings"]
    raw, none, full = (base.select("*") for _ in range(3))
    value = lambda k: derive.constant_k(base, "batting", k).groupBy().agg(get("batting", "regressed_sr").column(), get("batting", "strike_rate").column(), get("batting", "expected_sr").column()).first()
    assert value(0.0)[0] == pytest.approx(value(0.0)[1]) and value(1e12)[0] == pytest.approx(value(1e12)[2], rel=1e-6)


def test_scope_reading_and_refusals():
    spans = {"4-7": (4, 7), "4 to 7": (4, 7), "5+": (5, 11), "3": (3, 3), "openers": (1, 2), "No. 3": (3, 3), "tail": (8, 11)}
    assert {k: scope.bounds(k, scope.POSITIONS, scope.POSITION_WORDS) for k in spans} == spans and scope.bounds((2, 4), scope.POSITIONS) == (2, 4)
    assert scope.normalise({"Ground": "X", "gender": "Both", "vs": None, "series": "n/a", "year": 2024}) == {"venue": "X", "gender": "all", "season": 2024}
    assert scope.normalise({"start_year": 2001, "end_year": 2003, "order": "top", "came_in": "early", "event_name": "A"}) == {"from_year": 2001, "to_year": 2003, "position": "top", "entry_phase": "early", "competition": "A"}
    for bad in ({"colour": "red"}, {"innings": 5}, {"result": "maybe"}, {"position": "??"}, {"position": "0-3"}, {"position": "12"}, {"position": "5-4"}, {"entry_wickets": "1-2-3"}, {"from_year": "soon"}):
        with pytest.raises(scope.ScopeError):
            scope.build("batting", **bad)
    with pytest.raises(scope.ScopeError):
        scope.build("bowling", position="1")
    with pytest.raises(scope.ScopeError):
        scope.build("batting", phase="death", entry_wickets="1")
    with pytest.raises(scope.ScopeError):
        engine.query_stats({}, "bowling", split_by="position")
    with pytest.raises(scope.ScopeError):
        engine.metrics_for("batting", ["hundreds"], True)


def test_gender_and_competition_complete_each_other(spark):
    eras = {"premier cup": ["Premier Cup", "Old Cup"], "women's premier cup": ["Women's Premier Cup"]}
    sexes = {"premier cup": "male", "women's premier cup": "female"}
    of = lambda **f: scope.build("batting", competitions=eras, genders=sexes, default_gender="male", **f)
    assert of(competition="Premier Cup 2019/20").filters == {"competition": ["Premier Cup", "Old Cup"], "season": "2019/20", "gender": "male"}
    assert of(competition="premier cup", gender="female").filters["competition"] == ["Women's Premier Cup"]
    assert of(gender="all").filters == {} and of(competition="Other 2024").filters == {"competition": ["Other"], "season": "2024", "gender": "male"}
    assert of().filters == {"gender": "male"} and of().notes and not of(competition="Premier Cup").notes
    df = spark.createDataFrame([("A", "B", "X"), ("C", "A", "X"), ("B", "C", "Y")], "team1 string, team2 string, venue string")
    assert scope.build("batting", team="A", venue="X").matches(df).count() == 2 and scope.build("batting", team="A", opposition="C").matches(df).count() == 1


def test_ball_level_figures_in_scope(tables):
    b = tables["balls"]
    got = rows(ballstats.player_stats(b, "bowling", split_by="opposition", scope=scope.build("bowling", team="Shrubs")), "player")
    assert set(got) == {"Elm", "Yew"} and got["Elm"].k == "Trees" and got["Elm"].wickets == 1
    assert {r.player for r in ballstats.player_stats(b, "batting", scope=scope.build("batting", team="Shrubs")).collect()} == {"Elm", "Yew"}
    assert [r.player for r in ballstats.compare(b, "batting", ["Oak", "Ash"]).collect()] == ["Oak", "Ash"]
    for k in ballstats.SPLITS:
        assert ballstats.player_stats(b, "batting", ["Ash"], k).count() == 1
    with pytest.raises(scope.ScopeError):
        ballstats.player_stats(b, "batting", scope=scope.build("batting", position="1"))


def test_split_season_counts_by_calendar_year(spark):
    df = spark.createDataFrame([("2023/24", 2024), ("2023/24", 2023), ("2024", 2024)], "season string, yr int")
    assert scope.build("batting", season="2024").apply(df).count() == 2


def test_estimator_recovers_known_talent(spark):
    base = spark.range(2500).select(F.col("id").alias("p"), (0.05 + 0.01 * F.randn(7)).alias("talent"))
    n = 200
    counts = base.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.floor(F.greatest(n * F.col("talent") + (n * 0.05 * 0.95) ** 0.5 * F.randn(11), F.lit(0.0)) + 0.5))
    rows_ = counts.select(F.lit("T20").alias("fgroup"), F.lit("m").alias("gender"), F.col("p").alias("player"), F.lit(2024).alias("yr"), "half", F.lit("wickets").alias("metric"), F.lit(float(n)).alias("n"), "x")
    h = study.halves(rows_).withColumn("w", F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    sums = h.groupBy("metric").agg(*(c.alias(k) for k, c in study.weighted("w", "a", "b").items()))
    tau2 = sums.select(study._cov()).first()[0]
    assert 0.05 * 0.95 / tau2 == pytest.approx(475, rel=0.35)


def test_elo_and_trees(spark):
    m = spark.createDataFrame([("p", "2024-01-01", 1, "A", "B", "A", False), ("p", "2024-01-02", 2, "A", "B", None, True), ("p", "2024-01-03", 3, "A", "B", None, False)], "pool string, date string, match_id long, team1 string, team2 string, winner string, tied boolean")
    got = rows(models.elo(m), "match_id")
    assert (got[1].before1, got[2].before1) == (1500.0, 1512.0) and 1511 < got[3].before1 < 1512
    model = json.dumps([{"feature": 0, "threshold": 1.0, "default_left": True, "left": -1.0, "right": {"feature": 1, "threshold": 0.0, "default_left": False, "left": 2.0, "right": 3.0}}, 0.5])
    x = spark.createDataFrame([(1.0, 5.0), (2.0, 0.0), (2.0, None), (None, 1.0)], "a double, b double")
    assert [r[0] for r in x.select(models.tree_scorer(model, ["a", "b"])).collect()] == [-0.5, 2.5, 3.5, -0.5]


def test_elo_holds_no_pool(spark):
    """Small batches, pools that share a partition and teams: no group is gathered in one call."""
    given = [(f"p{i % 3}", f"2024-01-{1 + i * 7 % 28:02d}", i, "ABCD"[i % 4], "ABCD"[(i + 1 + i // 4 % 3) % 4], None if i % 9 == 0 else "ABCD"[i % 4], i % 11 == 0) for i in range(200)]
    m = spark.createDataFrame(given, "pool string, date string, match_id long, team1 string, team2 string, winner string, tied boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = models.elo(m)
        got = rows(df, "match_id")
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rating = {}
    for pool, _, i, a, b, winner, tied in sorted(given, key=lambda r: r[:3]):
        ra, rb = rating.get((pool, a), 1500.0), rating.get((pool, b), 1500.0)
        assert (got[i].before1, got[i].before2) == pytest.approx((ra, rb))
        if tied or winner:
            gain = 24.0 * ((0.5 if tied else float(winner == a)) - 1 / (1 + 10 ** ((rb - ra) / 400.0)))
            rating[pool, a], rating[pool, b] = ra + gain, rb - gain


def test_models_train(spark):
    d = spark.range(400).select((F.rand(1) * 4).alias("a"), F.when(F.rand(2) > 0.1, F.rand(3)).alias("b")).withColumn("y", (F.col("a") > 2).cast("double"))
    scored = models.train_win_model(d, ["a", "b"]).transform(d)
    assert scored.filter(F.col("_yl") == F.col("y")).count() > 360
    forest = models.train_next_ball(d.withColumnRenamed("y", "outcome"), ["a", "b"]).transform(d)
    assert forest.filter(F.col("prediction") == F.col("y")).count() > 360


def test_key_moments_do_not_overlap(spark):
    m = spark.createDataFrame([(1, 1, 3, 0.3), (1, 2, 2, 0.2), (1, 5, 5, -0.1), (1, 9, 9, 0.01)], "match_id long, start long, stop long, swing double")
    assert sorted(r.start for r in models.key_moments(m).collect()) == [1, 5]


def test_resolution(spark):
    names = spark.createDataFrame([("John Smith", 100, True), ("Jane Smith", 3, False), ("Peter Müller", 50, False)], "player string, matches long, international boolean")
    got = rows(resolve.lookup(resolve.catalog(names), ["John Smith", "J Smith", "p muller", "Smyth"]), "request")
    assert got["John Smith"].player == "John Smith" and got["J Smith"].player == "John Smith" and got["p muller"].player == "Peter Müller"
    assert spark.range(1).select(norm(F.lit("O'Brién-Kay. St"))).first()[0] == "obrien kay st"
    assert resolve.word("Women's", resolve.GENDERS, "gender") == "female"
    with pytest.raises(ValueError):
        resolve.word("x", resolve.FORMATS, "format")


def test_entities_by_name_alias_words_and_spelling(spark):
    names = spark.createDataFrame([("Royal Oaks", 90), ("Royal Elms", 20), ("Green Ashes", 50), ("Grey Ashes", 40), ("Old Oaks", 5), (None, 3)], "name string, weight long")
    asked = spark.createDataFrame([("royal  oaks",), ("RO",), ("royal",), ("ashes",), ("Gren Ashes",), ("Old Oaks",), ("nobody at all",), (None,)], "request string")
    got = rows(resolve.entities(names, asked, {"ro": "Royal Oaks"}, [("Royal Oaks", "Old Oaks")]), "request")
    assert {k: (r.name, r.how) for k, r in got.items()} == {"royal  oaks": ("Royal Oaks", "exact"), "RO": ("Royal Oaks", "alias"), "royal": ("Royal Oaks", "words"), "ashes": (None, "words"), "Gren Ashes": (None, "close"), "Old Oaks": ("Old Oaks", "exact"), "nobody at all": (None, None), None: (None, None)}
    assert got["royal"].names == ["Royal Oaks", "Old Oaks"] and got["ashes"].candidates == ["Green Ashes", "Grey Ashes"]


def test_ambiguity_depends_on_how_well_players_are_known(spark):
    names = spark.createDataFrame([("John Smith", 100, False), ("Jane Smith", 40, False), ("Adam Hill", 100, False), ("Anna Hill", 10, False)], "player string, matches long, international boolean")
    got = rows(resolve.lookup(resolve.catalog(names), ["Smith", "Hill", "J Smith"]), "request")
    assert (got["Smith"].player, got["Hill"].player, got["J Smith"].player) == (None, "Adam Hill", "John Smith")


def test_results_for_readers(spark):
    df = spark.range(40).select(F.concat(F.lit("p"), "id").alias("player"), F.col("id").alias("season"), (F.col("id") / 2).alias("runs")).orderBy("season")
    shown = results.records(df)
    assert len(shown["rows"]) == 25 and shown["rows"][3] == {"player": "p3", "season": 3, "runs": 1.5} and shown["rows_not_shown"] == "15 more rows not shown"
    assert results.records(df, 5, last=True)["rows"][-1]["season"] == 39 and results.records(df.limit(0)) == {"rows": [], "empty": True}
    kind, points = results.series(df, "season", ["runs"])
    assert kind == "line" and points.columns == ["x", "runs"] and points.first() == ("0", 0.0)
    for x, ys in (("nothing", ["runs"]), ("season", ["player"]), ("season", [])):
        with pytest.raises(ValueError):
            results.series(df, x, ys)
    own, filters = {"metric", "limit", "min_balls"}, {"team", "season", "ground"}
    assert results.repaired({"metric": "runs", "team": "A", "venue": "", "filters": {"limit": 5, "season": "2024", "ground": None}, "sort": "x"}, own, filters) == {"metric": "runs", "limit": 5, "filters": {"season": "2024", "team": "A"}}


def test_win_rows_chase_a_target(tables):
    got = {(r.innings, r.seq): r for r in models.win_rows(tables["balls"]).collect()}
    first = max(r.score_after for (i, _), r in got.items() if i == 1)
    assert got[1, 1].target is None and got[1, 1].won == 1 and got[2, 1].won == 0 and got[2, 1].target == first + 1
    assert (got[2, 1].balls_left, got[2, 1].wickets_left, got[2, 2].wickets_left) == (119, 10, 8)
    assert got[2, 1].required == pytest.approx(6 * got[2, 1].needed / 119)


def test_gate_and_split_names(spark):
    old = spark.range(1000).withColumn("x", F.lit(1))
    assert [r.ok for r in insights.gate(old.filter("id >= 5"), old).collect()] == [True, True]
    assert [r.ok for r in insights.gate(old.filter("id >= 6").drop("x"), old).collect()] == [False, False] and [r.ok for r in insights.gate(old.limit(0), old.limit(0)).collect()] == [True, False]
    assert engine.named_split(spark.createDataFrame([(1, 2)], "k long, innings long"), "innings").columns == ["innings_no", "innings"]


def test_guarded_sql(spark):
    spark.range(500).createOrReplaceTempView("guarded_numbers")
    run = lambda q: sqlguard.run_sql(spark, q, views=["guarded_numbers"])
    assert run("select id from guarded_numbers where 'drop table x' <> ''; ").count() == 200
    assert run("with q as (select id as add from guarded_numbers) select sum(add) as s, 'a--b' as x, 'a/*b*/c' as y, 'it''s; ' as z from q -- ends").first() == (124750, "a--b", "a/*b*/c", "it's; ")
    assert run("select t.x, count(*) from guarded_numbers lateral view explode(array(1, 2)) t as x where id in (select id from guarded_numbers where id < 3) group by 1 having count(*) > 1 order by 1").count() == 2
    refused = (
        "drop table x", "select 1; select 2", "select * from parquet.`/etc`", "with a as (select 1) insert into b select 1", "explain select 1", "set x = 1", "begin select 1; end", "select",
        "select count(*) from `parquet`.`/etc`", "select reflect('java.lang.System', 'getProperty', 'user.dir')", "select id from guarded_numbers where id = (select count(*) from json.`/etc/x`)",
        "select java_method('a', 'b')", "select * from other_table", "select * from identifier('parquet.`/etc`')", "execute immediate 'drop table x'", "select input_file_name() from guarded_numbers", "select db.f(1)",
    )
    for bad in refused:
        with pytest.raises(sqlguard.SqlRefused):
            run(bad)
    assert {(r.table, r.rows, r.column) for r in sqlguard.listing(spark, ["guarded_numbers"]).collect()} == {("guarded_numbers", 500, "id")}


def test_pages(spark):
    html = "<h2>Men</h2><p>12 of 1,300 matches</p><dl><dt>2024-01-02</dt><dd>Trees vs Shrubs</dd></dl><script>1 of 2</script>"
    d = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [tuple(r)[1:] for r in pages.coverage_rows(d).collect()] == [("Men", 12, 1300)]
    assert [tuple(r)[1:] for r in pages.missing_rows(d).collect()] == [("Men", "2024-01-02", "Trees", "Shrubs")]
    n, reason = pages.withheld("x")
    r = spark.createDataFrame([("12 matches are withheld because <b>of doubt</b>. More",)], "x string").select(n, reason).first()
    assert tuple(r) == (12, "of doubt")


def test_curation(spark):
    turns = spark.createDataFrame([(1, 0, "user", "I saw 3"), (1, 1, "assistant", "3 and 4.5"), (2, 0, "assistant", "hi"), (3, 0, "user", "a"), (3, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.fault for r in curation.conversation_faults(turns).collect()} == {1: None, 2: "opens wrongly", 3: "gap"}
    assert [r.loose for r in curation.ungrounded_numbers(turns).collect()] == [["4.5"]]
    pairs = spark.createDataFrame([("Won 3 games", "They won 3 games"), ("Won 3 games", "They won games"), ("A b", "a, B!")], "original string, rewrite string")
    assert curation.accepted_paraphrases(pairs).count() == 1
    calls = spark.createDataFrame([("f", "f", '{"a":"1"}', '{"a":"1"}'), ("f", "g", '{"a":"1"}', "{oops")], "expected_tool string, tool string, expected_args string, args string")
    r = curation.tool_choice(calls).first()
    assert (r.n, r.tool, r.valid, r.exact) == (2, 0.5, 0.5, 0.5)
    said = spark.createDataFrame([(["Oak", "4.5"], "It was Oak, with 4.5.", 1, 2.0), (["Elm"], "It was Oak.", 3, 4.0)], "expected array<string>, answer string, calls int, seconds double")
    assert tuple(curation.answers(said).first()) == (2, 0.5, 2.0, 3.0)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, build in (("w", lambda d: feeds.windowed(d, late=None)), ("r", feeds.running_totals)):
        stream = feeds.read(spark, str(tmp_path / "in"), events.schema, 1)
        q = build(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        a, b = spark.table(f"out_{name}"), build(events)
        keys = [c for c in a.columns if c != "total"]
        assert a.select(keys).exceptAll(b.select(keys)).count() == 0 and a.count() == b.count()


def test_stream_upserts(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string").write.mode("append").parquet(str(tmp_path / "in2"))
    upsert = feeds.upsert_into(path, "k")
    upsert(spark.read.parquet(str(tmp_path / "in")), 0)
    upsert(spark.read.parquet(str(tmp_path / "in2")), 1)
    upsert(spark.read.parquet(str(tmp_path / "in2")), 1)
    assert sorted(tuple(r) for r in feeds.latest(spark, path).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stored_tables_are_built_once_for_each_version(spark, tmp_path):
    import threading
    import time

    source, built = str(tmp_path / "in.parquet"), []
    spark.range(5).write.parquet(source)

    def build(tables):
        built.append(1)
        return spark.read.parquet(source)

    make = lambda: Stored(spark, str(tmp_path), {"a": build, "b": lambda tables: tables["a"].filter("id > 1")}, [source])
    counts = []
    threads = [threading.Thread(target=lambda: counts.append(make()["b"].count())) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert counts == [3, 3, 3] and len(built) == 1
    time.sleep(1.1)
    spark.range(9).write.mode("overwrite").parquet(source)
    assert make()["b"].count() == 7 and len(built) == 2
    laid = Stored(spark, "laid", {"a": lambda _: spark.range(100).select((99 - F.col("id")).alias("id"))}, [source], {"a": "id"})
    files = {}
    for r in laid["a"].selectExpr("id", "input_file_name() f").collect():
        files.setdefault(r.f, []).append(r.id)
    assert files and all(ids == list(range(min(ids), max(ids) + 1)) for ids in files.values())


def test_next_ball_rows_know_nothing_of_the_ball(tables):
    got = {(r.innings, r.seq): r for r in models.next_ball_rows(tables["balls"]).collect()}
    first, fourth = got[1, 1], got[1, 4]
    assert (first.score, first.wickets, first.striker_balls, first.bowler_balls) == (0, 0, 0, 0)
    assert (fourth.score, fourth.striker_balls, fourth.striker_runs, fourth.bowler_balls, fourth.outcome) == (9, 2, 5, 1, "6")


def test_plans_push_down_and_prune(spark):
    plan = ledger.balls(spark, "/root/testdata/sf0.001").filter("gender = 'BUILDING'").groupBy("bowler").agg(F.sum("bowler_runs"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "s_acctbal" not in plan.split("== Physical Plan ==")[1]


def test_flags_phase_and_overs(spark):
    d = spark.createDataFrame([("T20", 5), ("T20", 6), ("ODI", 39), ("MULTI", 90)], "fgroup string, over int")
    assert [tuple(r) for r in d.select(flags.phase(), flags.state_over()).collect()] == [("powerplay", 5), ("middle", 6), ("middle", 39), (None, 9)]
    assert d.limit(1).select(flags.overs_text(F.lit(57))).first()[0] == "9.3"
