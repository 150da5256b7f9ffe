"""Scans: delimited files, JSON lines, meeting documents, benchmark reports, stored results. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORRECTIONS = "edit_id string, edit_timestamp string, edit_updated_at string, before_text string, after_text string, edited_by string, utterance_start string, utterance_end string, audio_url string, youtube_url string, meeting_name string, meeting_date string, utterance_id string, meeting_id string, city_id string"
UTTERANCE = "struct<id:string,text:string,startTimestamp:double,endTimestamp:double,lastModifiedBy:string>"
MEETING = f"meeting struct<id:string,cityId:string,name:string,dateTime:string,audioUrl:string>, taskStatus struct<humanReview:boolean>, people array<struct<id:string,name:string,role:string,party:string>>, transcript array<struct<speakerTagId:string,speakerTag:struct<personId:string,label:string>,utterances:array<{UTTERANCE}>>>"
REPORT = "items array<struct<itemId:string,cityId:string,meetingId:string,referenceText:string,startSec:double,durationSec:double,perProvider:map<string,struct<status:string,hypothesisText:string,perMetric:map<string,struct<numerator:bigint,denominator:bigint>>>>>>"
BOUNDARY = "utterance_id string, row_sig string, boundary_status string, start_adj double, end_adj double, mean_score double"


def corrections(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Edit rows as text, of a CSV with quoted line breaks; ragged and broken rows keep what they have."""
    rows = spark.read.schema(CORRECTIONS).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    return rows.select(*columns) if columns else rows


def typed_edits(rows: DataFrame) -> DataFrame:
    """Times and seconds of edit rows; what cannot be read is null."""
    return rows.withColumns({"edit_ts": F.try_to_timestamp("edit_timestamp"), "start": F.col("utterance_start").try_cast("double"), "end": F.col("utterance_end").try_cast("double")})


def spans(rows: DataFrame) -> DataFrame:
    """One row per utterance with its first known times and recording."""
    from palimpsest.operators.chains import first_known

    return first_known(typed_edits(rows), "utterance_id", "edit_ts", ["start", "end", "audio_url"])


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def json_lines(spark: SparkSession, paths: str | list[str], schema: str, keep_broken: bool = False) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, truncated ones too, or kept in ``_corrupt`` to be counted."""
    if not keep_broken:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths)


def meetings(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(MEETING).option("multiLine", True).json(path)


def utterances(docs: DataFrame) -> DataFrame:
    """Valid utterances in order, ``seq`` from 0 within the meeting, with speaker tag, person and name; ``dropped`` ones have no id or times."""
    seg = docs.select(F.col("meeting.cityId").alias("city_id"), F.col("meeting.id").alias("meeting_id"), "people", F.posexplode("transcript").alias("seg", "s"))
    rows = seg.select("city_id", "meeting_id", "people", "seg", F.col("s.speakerTagId").alias("speaker_tag"), F.col("s.speakerTag.personId").alias("person_id"), F.posexplode("s.utterances").alias("pos", "u"))
    named = F.get(F.filter("people", lambda p: p["id"] == F.col("person_id")), F.lit(0))["name"]
    rows = rows.filter("u.id IS NOT NULL AND u.startTimestamp IS NOT NULL AND u.endTimestamp IS NOT NULL")
    w = Window.partitionBy("city_id", "meeting_id").orderBy("seg", "pos")
    return rows.select("city_id", "meeting_id", (F.row_number().over(w) - 1).alias("seq"), F.col("u.id").alias("utterance_id"), F.col("u.text").alias("text"), F.col("u.startTimestamp").alias("start"), F.col("u.endTimestamp").alias("end"), F.col("u.lastModifiedBy").alias("modified_by"), "speaker_tag", "person_id", named.alias("speaker_name"))


def never_edited(rows: DataFrame) -> DataFrame:
    return rows.filter("modified_by IS NULL AND end > start AND trim(text) <> ''")


def people(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("meeting.cityId").alias("city_id"), F.col("meeting.id").alias("meeting_id"), F.explode("people").alias("p")).select("city_id", "meeting_id", F.col("p.id").alias("person_id"), F.col("p.name").alias("name"), F.col("p.role").alias("role"), F.col("p.party").alias("party"))


def report_items(spark: SparkSession, path: str) -> DataFrame:
    """One row per benchmark window, provider results as a map."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.explode("items").alias("i")).select("i.*")


def common_items(items: DataFrame, providers: list[str]) -> DataFrame:
    """Windows for which every one of the providers succeeded."""
    ok = lambda p: F.coalesce(F.element_at("perProvider", p)["status"] == "ok", F.lit(False))
    out = items
    for p in providers:
        out = out.filter(ok(p))
    return out


def agreed_tokens(hypotheses: list[Column]) -> Column:
    """Distinct tokens that all hypotheses have."""
    out = hypotheses[0]
    for h in hypotheses[1:]:
        out = F.array_intersect(out, h)
    return F.array_distinct(out)


def sampled_rows(rows: DataFrame, key: str, n: int, seed: str, score: str | None = None, threshold: float = 0.2, upper: float = 0.35, explore: float = 0.25, skip: DataFrame | None = None) -> DataFrame:
    """A seeded sample; with ``score`` two lanes: up to the threshold, and an exploring share between it and the upper bound."""
    from palimpsest.functions.scalars import hash_order

    pool = rows if skip is None else rows.join(skip.select(key), key, "left_anti")
    take = lambda df, k: df.orderBy(hash_order(seed, F.col(key)), key).limit(k)
    if score is None:
        return take(pool, n)
    few = int(n * explore)
    return take(pool.filter(F.col(score) <= threshold), n - few).unionByName(take(pool.filter((F.col(score) > threshold) & (F.col(score) <= upper)), few))


def shard_rows(spark: SparkSession, paths: str | list[str], columns: dict[str, Column | str]) -> DataFrame:
    """Rows of Parquet shards in one form: ``columns`` (name -> column) and ``row_id``, the file and the row's place in it.

    Only the columns that are named are read; Spark deals row groups to tasks."""
    rows = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    place = F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
    return rows.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()), place.alias("row_id"))
