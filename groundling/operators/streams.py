"""Outputs of generation engines: event streams, response lines, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundling.functions import text as tx

LENGTH_STOPS = ["max_tokens", "max_output_tokens", "length"]
_EVENT = "type string, event struct<type:string,delta:struct<type:string,text:string,stop_reason:string>>, subtype string, is_error boolean, result string"
_LINE = "response string, done boolean, done_reason string, error string"


def _read(line: Column, schema: str) -> Column:
    """A JSON object, null where the line is none."""
    return F.when(F.try_parse_json(line).isNotNull(), F.from_json(line, schema))


def _ordered(c: Column) -> Column:
    """Values of a collected array of (pos, x) in order of place."""
    return F.transform(F.array_sort(c), lambda s: s["x"])


def assemble_stream(lines: DataFrame) -> DataFrame:
    """(job, text, truncated, error) of event lines (job, pos, line).

    Text deltas are joined; a final result that is not blank wins; an error
    result gives its text as the error; lines that are no JSON are skipped.
    """
    e = F.col("e")
    read = lines.select("job", "pos", _read(F.col("line"), _EVENT).alias("e"))
    delta = (e["type"] == "stream_event") & (e["event"]["type"] == "content_block_delta") & (e["event"]["delta"]["type"] == "text_delta")
    stop = (e["type"] == "stream_event") & (e["event"]["type"] == "message_delta") & F.lower(F.trim(e["event"]["delta"]["stop_reason"])).isin(LENGTH_STOPS)
    final = F.when(e["type"] == "result", F.struct("pos", F.struct(F.coalesce(e["result"], F.lit("")).alias("result"), F.coalesce(e["is_error"], F.lit(False)).alias("bad"), F.coalesce(e["subtype"], F.lit("")).alias("subtype")).alias("x")))
    grouped = read.groupBy("job").agg(
        F.array_join(_ordered(F.collect_list(F.when(delta, F.struct("pos", F.coalesce(e["event"]["delta"]["text"], F.lit("")).alias("x"))))), "").alias("said"),
        F.coalesce(F.bool_or(stop), F.lit(False)).alias("truncated"),
        F.max(final).alias("final"),
    )
    last = F.col("final.x")
    bad = F.coalesce(last["bad"], F.lit(False))
    error = F.when(bad, F.when(last["result"] != "", last["result"]).when(last["subtype"] != "", last["subtype"]).otherwise(F.lit("provider reported an error"))).otherwise(F.lit(""))
    chosen = F.when(bad, F.lit("")).when(tx.strip(F.coalesce(last["result"], F.lit(""))) != "", last["result"]).otherwise(F.col("said"))
    return grouped.select("job", chosen.alias("text"), "truncated", error.alias("error"))


def assemble_ndjson(lines: DataFrame) -> DataFrame:
    """(job, text, truncated, error) of response lines (job, pos, line), up to the first that is done, an error or no JSON."""
    e = F.col("e")
    read = lines.select("job", "pos", _read(F.col("line"), _LINE).alias("e"))
    failed = F.when(e.isNull(), F.lit("invalid line")).when(F.coalesce(e["error"], F.lit("")) != "", e["error"])
    marked = read.select("job", "pos", failed.alias("failed"), F.coalesce(e["done"], F.lit(False)).alias("done"), (e["done_reason"] == "length").alias("long"), F.coalesce(e["response"], F.lit("")).alias("response"))
    ends = marked.where(F.col("failed").isNotNull() | F.col("done")).groupBy("job").agg(F.min(F.struct("pos", "failed", "long")).alias("end"))
    joined = marked.join(ends, "job", "left")
    kept = F.when((F.col("end").isNull() | (F.col("pos") <= F.col("end.pos"))) & F.col("failed").isNull(), F.struct("pos", F.col("response").alias("x")))
    grouped = joined.groupBy("job").agg(F.array_join(_ordered(F.collect_list(kept)), "").alias("text"), F.first("end").alias("end"))
    return grouped.select("job", "text", (F.col("end.failed").isNull() & F.coalesce("end.long", F.lit(False))).alias("truncated"), F.coalesce("end.failed", F.lit("")).alias("error"))


def first_success(attempts: DataFrame) -> DataFrame:
    """(job, engine, text) of the first attempt (job, rank, engine, text, error) without an error; the last error where all failed."""
    ok = F.col("error") == ""
    grouped = attempts.groupBy("job").agg(F.min(F.when(ok, F.struct("rank", "engine", "text"))).alias("best"), F.max(F.struct("rank", "error")).alias("last"))
    return grouped.select("job", F.coalesce("best.engine", F.lit("")).alias("engine"), F.coalesce("best.text", F.lit("")).alias("text"), F.when(F.col("best").isNull(), F.col("last.error")).otherwise(F.lit("")).alias("error"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("job"), "turn", F.col("text").alias("t"))
    delta = turns.select("job", F.col("turn").alias("pos"), F.to_json(F.struct(F.lit("stream_event").alias("type"), F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("t").alias("text")).alias("delta")).alias("event"))).alias("line"))
    jobs = turns.select("job").distinct()
    odd = jobs.select("job", F.lit(-1).cast("long").alias("pos"), F.lit('{"type": "stream_event", "ev').alias("line"))
    stop = jobs.select("job", F.lit(1000).cast("long").alias("pos"), F.concat(F.lit('{"type":"stream_event","event":{"type":"message_delta","delta":{"stop_reason":"'), F.when(F.col("job") % 3 == 0, " MAX_tokens").otherwise("end_turn"), F.lit('"}}}')).alias("line"))
    kinds = F.when(F.col("job") % 5 == 1, F.concat(F.lit('{"type":"result","result":"Final '), F.col("job").cast("string"), F.lit('"}'))).when(F.col("job") % 5 == 2, '{"type":"result","is_error":true,"subtype":"error_max"}').when(F.col("job") % 5 == 3, '{"type":"result","result":"  "}').when(F.col("job") % 5 == 4, '{"type":"result","is_error":true}')
    final = jobs.select("job", F.lit(1001).cast("long").alias("pos"), kinds.alias("line")).where("line is not null")
    return delta.unionByName(odd).unionByName(stop).unionByName(final)


def _response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("job"), F.col("turn").alias("pos"), F.col("text").alias("t"))
    made = F.to_json(F.struct(F.col("t").alias("response"), ((F.col("pos") == 2) & (F.col("job") % 2 == 0)).alias("done"), F.when(F.col("job") % 4 == 0, "length").otherwise("stop").alias("done_reason")))
    line = F.when((F.col("job") % 7 == 3) & (F.col("pos") == 1), '{"error":"model not found"}').when((F.col("job") % 7 == 5) & (F.col("pos") == 1), "{oops").otherwise(made)
    return turns.select("job", "pos", line.alias("line"))


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = (F.col("conv_id") * 5 + F.col("turn")) % 3 != 0
    return _turns(spark, sf_dir).select(F.col("conv_id").alias("job"), F.col("turn").alias("rank"), F.concat(F.col("role"), F.lit("-"), F.col("turn").cast("string")).alias("engine"), F.col("text"), F.when(bad, F.concat(F.lit("offline "), F.col("turn").cast("string"))).otherwise("").alias("error"))


QUERIES = {
    "assemble_stream": lambda s, d: assemble_stream(_event_lines(s, d)),
    "assemble_ndjson": lambda s, d: assemble_ndjson(_response_lines(s, d)),
    "first_success": lambda s, d: first_success(_attempts(s, d)),
}
ORACLE_SQL = {
    "assemble_stream": """with a as (select conv_id as job, string_agg(text, '' order by turn) as said from conversations group by conv_id)
        select job, case job % 5 when 1 then 'Final ' || job when 2 then '' when 4 then '' else said end as text, job % 3 = 0 as truncated, case job % 5 when 2 then 'error_max' when 4 then 'provider reported an error' else '' end as error from a""",
    "assemble_ndjson": """with t as (select conv_id as job, turn, text as t, case when conv_id % 7 in (3, 5) and turn = 1 then 'bad' when turn = 2 and conv_id % 2 = 0 then 'done' else 'go' end as k from conversations),
        e as (select job, min(turn) filter (k <> 'go') as stop, arg_min(k, turn) filter (k <> 'go') as how from t group by job)
        select job, coalesce(string_agg(t, '' order by turn) filter (k <> 'bad' and (stop is null or turn <= stop)), '') as text, coalesce(any_value(how) = 'done', false) and job % 4 = 0 as truncated,
        case when any_value(how) = 'bad' then case when job % 7 = 3 then 'model not found' else 'invalid line' end else '' end as error from t join e using (job) group by job""",
    "first_success": """with a as (select conv_id as job, turn, role || '-' || turn as engine, text, (conv_id * 5 + turn) % 3 = 0 as ok from conversations)
        select job, coalesce(arg_min(engine, turn) filter (ok), '') as engine, coalesce(arg_min(text, turn) filter (ok), '') as text, case when bool_or(ok) then '' else 'offline ' || max(turn) end as error from a group by job""",
}
