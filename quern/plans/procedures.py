"""Queries of generation, export, merging and reports, added to the catalogue's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import merging, overlap, selection, stats, synth
from quern.plans.catalogue import EVENTS, N, ORACLE_SQL, TASKS, _dated, _report_sql, _split_tasks, query, read
from quern.sources import model, records


@query("select round(avg(value) filter (event_type = 'error') - avg(value) filter (event_type = 'view'), 6) as value_delta, round(avg(user_id) filter (event_type = 'error') - avg(user_id) filter (event_type = 'view'), 6) as user_id_delta from events")
def mean_differences(spark: SparkSession, d: str) -> DataFrame:
    return stats.mean_differences(read(spark, d, "events"), "event_type", "error", "view", ["value", "user_id"])


@query("select event_type, round(avg(value), 6) as mean, 50.0::double as external, round(avg(value) - 50, 6) as delta, true as informational from events group by event_type")
def external_delta(spark: SparkSession, d: str) -> DataFrame:
    return stats.external_delta(read(spark, d, "events"), "event_type", "value", 50.0)


@query("select event_id, case when event_id % 2 = 0 then user_id else coalesce(max(case when event_id % 2 = 0 then user_id end) over (partition by event_id // 2), user_id) end as user_id from events")
def aligned_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("event_id", "user_id", F.expr("event_id div 2").alias("pair"))
    return merging.copy_within_pair(e, "pair", F.col("event_id") % 2 == 0, "user_id").select("event_id", "user_id")


@query("with p as (select c_custkey::bigint as id_a, c_custkey::bigint + 1 as id_b from customer where c_custkey % 2 = 1), e as (select event_id, user_id::bigint as winner from events where event_type = 'error') select id_a, id_b, coalesce(arg_min(winner, event_id), id_a) as winner from p left join e on winner = id_a or winner = id_b group by id_a, id_b")
def first_decision(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of customers; the earliest error of one of the two names the winner."""
    key = F.col("c_custkey").cast("bigint")
    pairs = read(spark, d, "customer").where("c_custkey % 2 = 1").select(key.alias("id_a"), (key + 1).alias("id_b"))
    said = read(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("pos"), F.col("user_id").cast("bigint").alias("winner"))
    return selection.pick_winner(pairs, said)


@query(f"select task_id, case when idx % 4 = 2 then 'cheap ' || idx when idx % 3 = 0 then 'dear ' || idx else subject end as subject, case when idx % 4 = 2 or idx % 3 = 0 then 'text' else body end as body from ({TASKS})")
def generated_or_template(spark: SparkSession, d: str) -> DataFrame:
    """Results of two models over templates: those with a blank part or without an index don't count."""
    t = synth.flat_tasks(spark, N).select("task_id", "idx", "subject", "body")
    made = lambda word, when, part: t.where(when).select(F.col("idx").cast("string").alias("idx"), F.concat(F.lit(word), F.col("idx")).alias("subject"), part.alias("body"))
    cheap = made("cheap ", "idx % 2 = 0", F.when(F.col("idx") % 4 == 0, " ").otherwise("text"))
    dear = made("dear ", "idx % 3 = 0", F.lit("text")).unionByName(spark.createDataFrame([("x", "no", "index")], "idx string, subject string, body string"))
    return merging.over_templates(t, "idx", [cheap, dear], ["subject", "body"]).select("task_id", "subject", "body")


_RAW = "case event_id % 4 when 0 then '{\"usage\": {\"cost\": ' || event_id || ', \"total_cost\": 1, \"prompt_tokens\": 5, \"completion_tokens\": 6}}' when 1 then '{\"usage\": {\"total_cost\": ' || event_id || '}, \"cost\": 2}' when 2 then '{\"cost\": ' || event_id || '}' else 'no json' end"


@query("select event_id, case event_id % 4 when 0 then 5 else 0 end::bigint as prompt_tokens, case event_id % 4 when 0 then 6 else 0 end::bigint as completion_tokens, case when event_id % 4 < 3 then event_id::double end as cost from events")
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and the first known cost of raw answers."""
    return read(spark, d, "events").select("event_id", model.usage(F.expr(_RAW)).alias("u")).select("event_id", "u.*")


@query("select event_id as step, event_id % 7 + 0.5::double as loss from events where event_id % 3 = 0")
def training_log(spark: SparkSession, d: str) -> DataFrame:
    line = "case event_id % 3 when 0 then '{\"loss\": ' || (event_id % 7) || '.5, \"step\": ' || event_id || '}' when 1 then '{\"step\": 1}' else '{\"eval_loss\": 2, \"step\": 3}' end"
    return records.training_log(read(spark, d, "events").select(F.expr(line).alias("value")))


@query(f"select max(max_shared) as max_shared, sum(ngram_pairs)::bigint as ngram_pairs, max(max_cosine) as max_cosine, sum(cosine_pairs)::bigint as cosine_pairs, any_value(f.n) as flags, bool_and(pass) and any_value(f.n) = 0 as passed from ({_report_sql(False)}) r, (select count(*) as n from ({ORACLE_SQL['provenance_issues']})) f")
def contamination_summary(spark: SparkSession, d: str) -> DataFrame:
    """The report of all splits in one row, with the flags of the dates."""
    r = overlap.report(_split_tasks(spark, False), "split", "task_id", "text", overlap.term_vectors)
    return overlap.summary(r, overlap.provenance_issues(_dated(spark), ["task_id"], "generated_at", EVENTS))


_SAID = "case turn % 3 when 0 then 'Subject: s' || turn || chr(10) || 'Body: ' || text when 1 then text else '{\"subject\": \"x\", \"body\": \"b' || turn || '\"}' end"


@query("select conv_id, turn, case turn % 3 when 0 then 's' || turn else '' end as labelled_subject, case turn % 3 when 2 then '{\"subject\": \"x\", \"body\": \"b' || turn || '\"}' else trim(text, ' ' || chr(10) || chr(9) || chr(13)) end as labelled_body, case turn % 3 when 2 then 'x' else '' end as json_subject, case turn % 3 when 2 then 'b' || turn when 1 then text else 'Subject: s' || turn || chr(10) || 'Body: ' || text end as json_body from conversations")
def parsed_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Answers as labelled sections, bare text and JSON, by both parsers."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("said"))
    c = c.withColumns({"l": text.parse_labelled(F.col("said")), "j": text.parse_output(F.col("said"))})
    return c.select("conv_id", "turn", F.col("l.subject").alias("labelled_subject"), F.col("l.body").alias("labelled_body"), F.col("j.subject").alias("json_subject"), F.col("j.body").alias("json_body"))


@query("select event_id, event_type from events order by event_id limit 25")
def head_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first rows by position, a feature of the drivers."""
    return selection.head(read(spark, d, "events").select("event_id", "event_type"), "event_id", 25)


@query("select doc_id, coalesce(quality, -1) as quality from documents left join (select doc_id, min(quality) as quality from labels group by doc_id) using (doc_id)")
def lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = read(spark, d, "documents").select("doc_id"), read(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return selection.lookup(docs, labels, "doc_id", {"quality": F.lit(-1)})
