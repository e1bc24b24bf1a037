"""Nested match documents to flat tables, upserts, exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The documents' schema, as far as it is read.
SCHEMA = """
meta struct<data_version:string,revision:int>,
info struct<match_type:string,gender:string,team_type:string,overs:int,balls_per_over:int,event:struct<name:string,match_number:string,stage:string>,dates:array<string>,venue:string,city:string,season:string,
  teams:array<string>,toss:struct<winner:string,decision:string>,outcome:struct<winner:string,by:struct<runs:int,wickets:int>,result:string,eliminator:string,bowl_out:string,method:string>,
  player_of_match:array<string>,players:map<string,array<string>>,registry:struct<people:map<string,string>>>,
innings array<struct<team:string,super_over:boolean,target:struct<runs:int,overs:double>,overs:array<struct<over:int,deliveries:array<struct<batter:string,bowler:string,non_striker:string,
  runs:struct<batter:int,extras:int,total:int,non_boundary:boolean>,extras:map<string,int>,wickets:array<struct<kind:string,player_out:string,fielders:array<struct<name:string>>>>>>>>>>
"""
EXTRAS = ("wides", "noballs", "byes", "legbyes", "penalty")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Match documents under a folder, at any depth, one file each; files that are no JSON are dropped.
    match_id is the file's name without its ending."""
    raw = spark.read.schema(SCHEMA + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return raw.withColumn("match_id", name).filter("_corrupt is null and info is not null").drop("_corrupt")


def zipped(spark: SparkSession, path: str) -> DataFrame:
    """The same from zip archives: each archive is opened in the task that reads it."""
    import pandas as pd

    def unzip(batches):
        import io
        import zipfile

        for pdf in batches:
            for content in pdf.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in sorted(z.namelist()):
                        if n.endswith(".json"):
                            try:
                                yield pd.DataFrame({"match_id": [n.rsplit("/", 1)[-1][:-5]], "doc": [z.read(n).decode()]})
                            except UnicodeDecodeError:
                                continue

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "match_id string, doc string")
    parsed = rows.select("match_id", F.from_json("doc", SCHEMA, {"mode": "PERMISSIVE"}).alias("d")).select("match_id", "d.*")
    return parsed.filter("info is not null")


def matches(docs: DataFrame) -> DataFrame:
    i = F.col("info")
    fields = {"match_type": i.match_type, "gender": i.gender, "team_type": i.team_type, "overs": i.overs, "balls_per_over": i.balls_per_over, "event_name": i.event["name"], "event_match": i.event.match_number, "event_stage": i.event.stage, "date": F.get(i.dates, F.lit(0)), "end_date": F.try_element_at(i.dates, F.lit(-1)), "venue": i.venue, "city": i.city, "season": i.season, "team1": F.get(i.teams, F.lit(0)), "team2": F.get(i.teams, F.lit(1)), "toss_winner": i.toss.winner, "toss_decision": i.toss.decision}
    o = i.outcome
    fields |= {"winner": o.winner, "win_by_runs": o.by.runs, "win_by_wickets": o.by.wickets, "result_type": o.result, "eliminator": o.eliminator, "bowl_out": o.bowl_out, "method": o.method, "player_of_match": F.get(i.player_of_match, F.lit(0)), "data_version": F.col("meta.data_version")}
    return docs.select("match_id", *(c.alias(k) for k, c in fields.items()), F.col("info.event.name").alias("event"))


def _balls(docs: DataFrame) -> DataFrame:
    a = docs.select("match_id", F.posexplode("innings").alias("i", "inn")).select("match_id", (F.col("i") + 1).alias("innings"), F.col("inn.team").alias("batting_team"), F.coalesce("inn.super_over", F.lit(False)).alias("super_over"), F.col("inn.target.runs").alias("target_runs"), F.col("inn.target.overs").alias("target_overs"), F.explode("inn.overs").alias("o"))
    return a.select("*", F.col("o.over").alias("over"), F.posexplode("o.deliveries").alias("b", "d")).withColumn("ball", F.col("b") + 1).drop("o", "b")


def deliveries(docs: DataFrame) -> DataFrame:
    """One row for each ball; ball counts from 1 within the over. Extras by kind, the kinds as text, the
    wickets in their order (kind, player_out, fielders), and whether the four or six was run."""
    extra = lambda k: F.coalesce(F.col("d.extras")[k], F.lit(0)).alias(k)
    kinds = F.array_join(F.array_sort(F.map_keys("d.extras")), "+").alias("extra_type")
    fallen = F.transform("d.wickets", lambda w: F.struct(w["kind"].alias("kind"), w["player_out"].alias("player_out"), F.transform(w["fielders"], lambda f: f["name"]).alias("fielders")))
    return _balls(docs).select("match_id", "innings", "batting_team", "super_over", "target_runs", "target_overs", "over", "ball", F.col("d.batter").alias("batter"), F.col("d.bowler").alias("bowler"), F.col("d.non_striker").alias("non_striker"), F.col("d.runs.batter").alias("runs_batter"), F.col("d.runs.extras").alias("runs_extras"), F.col("d.runs.total").alias("runs_total"), F.coalesce("d.runs.non_boundary", F.lit(False)).alias("non_boundary"), *map(extra, EXTRAS), kinds, F.coalesce(fallen, F.array().cast("array<struct<kind:string,player_out:string,fielders:array<string>>>")).alias("wickets"))


def wickets(docs: DataFrame) -> DataFrame:
    """One row for each wicket; a ball can have several."""
    rows = _balls(docs).select("match_id", "innings", "over", "ball", F.col("d.bowler").alias("bowler"), F.posexplode("d.wickets").alias("n", "w"))
    return rows.select("match_id", "innings", "over", "ball", "bowler", (F.col("n") + 1).alias("wicket"), "w.kind", "w.player_out", F.transform("w.fielders", lambda f: f["name"]).alias("fielders"))


def players(docs: DataFrame) -> DataFrame:
    rows = docs.select("match_id", "info.registry.people", F.explode("info.players").alias("team", "names"))
    return rows.select("match_id", "team", "people", F.explode("names").alias("player")).select("match_id", "team", "player", F.col("people")[F.col("player")].alias("player_id"))


def legacy_flags(deliveries: DataFrame) -> DataFrame:
    """Old tables with one extra_type and runs_extras: byes and leg-byes on a no-ball go to the bowler."""
    of = lambda k: F.when(F.col("extra_type") == k, F.col("runs_extras")).otherwise(0)
    return deliveries.withColumns({k: of(k) for k in EXTRAS} | {"non_boundary": F.lit(False)})


def register_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def alternate_names(names: DataFrame, people: DataFrame) -> DataFrame:
    """(identifier, name): the listed alternates and the register's own names that they lack."""
    own = people.select("identifier", "name").filter("identifier is not null and name is not null")
    return names.select("identifier", "name").unionByName(own.join(names.select("identifier", "name"), ["identifier", "name"], "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str = "match_id") -> DataFrame:
    """The old rows of keys that are not in the batch, and the batch."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def export(df: DataFrame, path: str, partition_by: Column | str | None = None) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, columns and an order-free fingerprint of the rows."""
    out = None
    for name, df in tables.items():
        row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("rows"), F.sum((F.col("h") % 1_000_003).cast("long")).alias("fingerprint")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), "fingerprint")
        out = row if out is None else out.unionByName(row)
    return out


def build_info(spark: SparkSession, facts: dict) -> DataFrame:
    """key, value (as JSON): what a build was made of, to be written beside its tables."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in sorted(facts.items())], "key string, value string")
