"""Catalogue part 2: run events, telemetry, tests, messages, guardrails (events / lineitem / conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import rules
from corpuslens.operators import guardrails, runs, telemetry
from corpuslens.plans.catalog import query, table, table_sql
from corpuslens.plans.oracle import q

# ---------------------------------------------------------------- telemetry --
MODEL_BY_EVENT = (("view", "qwen-max"), ("click", "qwen-plus"), ("signup", "qwen-turbo"),
                  ("purchase", "QWEN-Max"), ("error", "unknown-model"))


def _case(col: str, pairs, default=None) -> str:
    body = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"CASE {col} {body}" + (f" ELSE {q(default)}" if default is not None else "") + " END"


def event_calls(spark, sf_dir):
    """events as model calls: model by event type, tokens from props.k, latency = value."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.expr(_case("event_type", MODEL_BY_EVENT))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), model.alias("model"),
                    (k * 100).alias("input_tokens"), (k * 10 + 5).alias("output_tokens"),
                    F.col("value").alias("latency_s"))


CALLS_SQL = (f"SELECT event_id, ts, {_case('event_type', MODEL_BY_EVENT)} AS model, "
             "CAST(json_extract(props, '$.k') AS BIGINT) * 100 AS input_tokens, "
             "CAST(json_extract(props, '$.k') AS BIGINT) * 10 + 5 AS output_tokens, value AS latency_s FROM events")
PRICE_SQL = "(VALUES " + ", ".join(f"({q(m)}, {i}, {o})" for m, i, o in rules.TOKEN_PRICING) + ") p(model, in_usd, out_usd)"
COSTED_SQL = (f"SELECT c.*, c.input_tokens / 1e6 * coalesce(p.in_usd, 0) + c.output_tokens / 1e6 * coalesce(p.out_usd, 0) "
              f"AS cost_usd FROM ({CALLS_SQL}) c LEFT JOIN {PRICE_SQL} ON lower(c.model) = p.model")


@query("call_cost", f"""
SELECT event_id, model, input_tokens, output_tokens, latency_s, round(cost_usd, 9) AS cost_usd FROM ({COSTED_SQL})
""")
def q_call_cost(spark, sf_dir):
    c = telemetry.call_cost(event_calls(spark, sf_dir))
    return c.select("event_id", "model", "input_tokens", "output_tokens", "latency_s",
                    F.round("cost_usd", 9).alias("cost_usd"))


@query("metrics_summary", f"""
SELECT CAST(count(*) AS BIGINT) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
       round(coalesce(avg(latency_s), 0), 6) AS average_latency_seconds,
       round(coalesce(sum(cost_usd), 0), 6) AS total_estimated_cost_usd
FROM ({COSTED_SQL})
""")
def q_metrics_summary(spark, sf_dir):
    s = telemetry.metrics_summary(telemetry.call_cost(event_calls(spark, sf_dir)))
    return s.select("total_calls", "total_input_tokens", "total_output_tokens",
                    F.round("average_latency_seconds", 6).alias("average_latency_seconds"),
                    F.round("total_estimated_cost_usd", 6).alias("total_estimated_cost_usd"))


LINE_MODEL = (("A", "qwen-max"), ("N", "qwen-plus"), ("R", "qwen-turbo"))


def lineitem_calls(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.expr(_case("l_returnflag", LINE_MODEL, "qwen-turbo")).alias("model"),
                     F.year("l_shipdate").alias("ship_year"),
                     (F.col("l_quantity").cast("long") * 100).alias("input_tokens"),
                     (F.col("l_linenumber").cast("long") * 40).alias("output_tokens"),
                     (F.col("l_discount") * 100).alias("latency_s"))


@query("cost_by_model", f"""
WITH c AS (
  SELECT {_case('l_returnflag', LINE_MODEL, 'qwen-turbo')} AS model, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
         CAST(l_quantity AS BIGINT) * 100 AS input_tokens, CAST(l_linenumber AS BIGINT) * 40 AS output_tokens,
         l_discount * 100 AS latency_s FROM lineitem),
k AS (SELECT c.*, input_tokens / 1e6 * coalesce(p.in_usd, 0) + output_tokens / 1e6 * coalesce(p.out_usd, 0) AS cost_usd
      FROM c LEFT JOIN {PRICE_SQL} ON lower(c.model) = p.model)
SELECT model, ship_year, CAST(count(*) AS BIGINT) AS total_calls, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, round(avg(latency_s), 6) AS average_latency_seconds,
       round(sum(cost_usd), 6) AS total_estimated_cost_usd
FROM k GROUP BY model, ship_year
""")
def q_cost_by_model(spark, sf_dir):
    s = telemetry.metrics_summary(telemetry.call_cost(lineitem_calls(spark, sf_dir)), by=("model", "ship_year"))
    return s.select("model", "ship_year", "total_calls", "total_input_tokens", "total_output_tokens",
                    F.round("average_latency_seconds", 6).alias("average_latency_seconds"),
                    F.round("total_estimated_cost_usd", 6).alias("total_estimated_cost_usd"))


# --------------------------------------------------------------- run events --
STATE_BY_EVENT = (("view", "AUDIT"), ("click", "PATCH"), ("signup", "TEST"), ("purchase", "COMMIT"), ("error", "ERROR"))


def run_events(spark, sf_dir):
    """events as run events: run = user, order = (ts, event_id), state by event type.

    seq (1, 2, ... per run) is a skew-safe running count, not a row_number window over the run.
    """
    from corpuslens.operators import sequence
    e = table(spark, sf_dir, "events")
    ev = e.select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
                  F.expr(_case("event_type", STATE_BY_EVENT)).alias("state"), F.lit(True).alias("_one"))
    return sequence.running_count(ev, "run_id", ["ts", "event_id"], "_one", "seq").drop("_one")


RUN_SQL = (f"SELECT user_id AS run_id, event_id, ts, {_case('event_type', STATE_BY_EVENT)} AS state, "
           "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
_EDGES = [(s, n) for s, d in {"AUDIT": ["PATCH", "ERROR"], "PATCH": ["TEST", "ERROR"],
                                "TEST": ["COMMIT", "PATCH", "ERROR"], "COMMIT": ["COMPLETED", "ERROR"]}.items()
          for n in d] + [(s, n) for s, _, n in rules.CODED_TRANSITIONS]

EDGES_SQL = "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in sorted(set(_EDGES))) + ") e(prev_state, state)"


@query("run_transitions", f"""
WITH r AS ({RUN_SQL}),
l AS (SELECT run_id, seq, lag(state) OVER (PARTITION BY run_id ORDER BY seq) AS prev_state, state FROM r)
SELECT l.run_id, CAST(l.seq AS BIGINT) AS seq, l.prev_state, l.state,
       CASE WHEN l.prev_state IS NULL THEN true ELSE e.state IS NOT NULL END AS legal
FROM l LEFT JOIN {EDGES_SQL} ON l.prev_state = e.prev_state AND l.state = e.state
""")
def q_run_transitions(spark, sf_dir):
    return runs.run_transitions(run_events(spark, sf_dir), runs.transitions_df(spark))


@query("run_outcome", f"""
WITH r AS ({RUN_SQL})
SELECT run_id, arg_max(state, seq) AS final_state, CAST(count(*) FILTER (WHERE state = 'PATCH') AS BIGINT) AS attempts,
       CAST(count(*) AS BIGINT) AS n_events,
       CASE WHEN arg_max(state, seq) IN ('COMPLETED', 'COMMIT') THEN 'SUCCESS'
            WHEN arg_max(state, seq) = 'ERROR' THEN 'ERROR' ELSE 'RUNNING' END AS outcome
FROM r GROUP BY run_id
""")
def q_run_outcome(spark, sf_dir):
    # The test events have no COMPLETED state: COMMIT ends a run in them.
    return runs.run_outcome(run_events(spark, sf_dir), terminal_ok=("COMMIT",))


# The paths of a run are the pages its user saw; those of its errors were not applied.
_APPLIED_SQL = f"""SELECT user_id AS run_id, event_type || '/' || CAST(event_id % 50 AS STRING) || '.py' AS path,
  CASE event_type WHEN 'error' THEN 'SEARCH_NOT_FOUND' ELSE 'APPLIED' END AS status FROM events"""


def _outcome_and_paths(spark, sf_dir):
    return runs.run_modified(runs.run_outcome(run_events(spark, sf_dir), terminal_ok=("COMMIT",)), table_sql(spark, sf_dir, _APPLIED_SQL))


_ENDED_SQL = f"""r AS ({RUN_SQL}), o AS (SELECT run_id, arg_max(state, seq) AS final_state FROM r GROUP BY run_id),
a AS (SELECT DISTINCT run_id, path FROM ({_APPLIED_SQL}) WHERE status = 'APPLIED')"""


@query("run_modified", f"""
WITH {_ENDED_SQL}
SELECT o.run_id, final_state, CAST(count(path) FILTER (final_state = 'COMMIT') AS BIGINT) AS n_modified
FROM o LEFT JOIN a ON o.run_id = a.run_id GROUP BY o.run_id, final_state
""")
def q_run_modified(spark, sf_dir):
    return _outcome_and_paths(spark, sf_dir)[0].select("run_id", "final_state", "n_modified")


@query("run_modified_files", f"""
WITH {_ENDED_SQL} SELECT o.run_id, path FROM o JOIN a ON o.run_id = a.run_id WHERE final_state = 'COMMIT'
""")
def q_run_modified_files(spark, sf_dir):
    return _outcome_and_paths(spark, sf_dir)[1]


@query("run_attempts", f"""
WITH r AS ({RUN_SQL})
SELECT run_id, CAST(seq AS BIGINT) AS seq, state,
       CAST(sum(CASE WHEN state = 'PATCH' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt
FROM r
""")
def q_run_attempts(spark, sf_dir):
    return runs.run_attempts(run_events(spark, sf_dir))


@query("dwell_time", f"""
WITH r AS ({RUN_SQL})
SELECT run_id, CAST(seq AS BIGINT) AS seq, state,
       round((epoch_us(lead(ts) OVER (PARTITION BY run_id ORDER BY seq)) - epoch_us(ts)) / 1e6, 6) AS dwell_s
FROM r
""")
def q_dwell_time(spark, sf_dir):
    d = runs.dwell_time(run_events(spark, sf_dir))
    return d.withColumn("dwell_s", F.round("dwell_s", 6))


# ------------------------------------------------------------- test results --
EXIT_BY_EVENT = (("view", "0"), ("click", "-1"), ("purchase", "5"), ("signup", "1"), ("error", "1"))
STDOUT_BY_EVENT = (("signup", "1 failed, 2 passed in 0.45s"), ("error", "collected 0 items"))
STDERR_BY_EVENT = (("error", "Traceback (most recent call last):\nModuleNotFoundError: No module named 'app'"),
                   ("click", "TimeoutExpired: Test run exceeded execution limits."),
                   ("purchase", "E   AssertionError: exit 5"))


def _results_sql() -> str:
    return (f"SELECT event_id, CAST({_case('event_type', EXIT_BY_EVENT)} AS INTEGER) AS exit_code, "
            "CASE WHEN event_type = 'click' THEN 'TIMEOUT' ELSE 'COMPLETED' END AS status, "
            f"{_case('event_type', STDOUT_BY_EVENT, '3 passed in 0.48s')} AS stdout, "
            f"{_case('event_type', STDERR_BY_EVENT, '')} AS stderr FROM events")


def test_results(spark, sf_dir):
    return table_sql(spark, sf_dir, _results_sql())


def _verdict_sql() -> str:
    words = " OR ".join(f"contains(lower(stdout || chr(10) || stderr), {q(w)})" for w in rules.COMPILATION_WORDS)
    return f"""t AS ({_results_sql()}),
v AS (SELECT event_id, exit_code, status,
        CASE WHEN status = 'TIMEOUT' THEN 'TIMEOUT' WHEN exit_code = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict,
        CASE WHEN exit_code <> 0 THEN CASE WHEN {words} THEN {q(rules.FAILURE_COMPILATION)}
             ELSE {q(rules.FAILURE_LOGIC)} END END AS failure_class FROM t)"""


@query("failure_class", f"WITH {_verdict_sql()} SELECT * FROM v")
def q_failure_class(spark, sf_dir):
    return runs.test_verdicts(test_results(spark, sf_dir)).select("event_id", "exit_code", "status", "verdict",
                                                                 "failure_class")


@query("verdict_counts", f"WITH {_verdict_sql()} SELECT status, verdict, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY ALL")
def q_verdict_counts(spark, sf_dir):
    return runs.verdict_counts(runs.test_verdicts(test_results(spark, sf_dir)))


@query("stderr_excerpt", f"""
WITH {_verdict_sql()}
SELECT t.event_id, left(t.stderr, 120) AS excerpt FROM t WHERE t.exit_code <> 0
""")
def q_stderr_excerpt(spark, sf_dir):
    t = test_results(spark, sf_dir)
    return t.where(F.col("exit_code") != 0).select("event_id", F.left("stderr", F.lit(120)).alias("excerpt"))


# ----------------------------------------------------------------- messages --
def conv_messages(spark, sf_dir):
    from corpuslens.operators import sequence
    c = table(spark, sf_dir, "conversations")
    c = sequence.neighbors(c.select("conv_id", "turn", "role", "text"), "conv_id", ["turn"], ["role"])
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("idx"), F.col("role").alias("sender"),
                    F.col("next_role").alias("recipient"), F.col("text").alias("message"))


MSG_SQL = ("SELECT conv_id AS run_id, turn AS idx, role AS sender, "
           "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS recipient, text AS message FROM conversations")


@query("message_matrix", f"SELECT sender, recipient, CAST(count(*) AS BIGINT) AS n FROM ({MSG_SQL}) GROUP BY ALL")
def q_message_matrix(spark, sf_dir):
    return runs.message_matrix(conv_messages(spark, sf_dir))


@query("message_delta", f"""
SELECT run_id, idx, idx AS event_seq, sender, recipient, md5(message) AS message_md5 FROM ({MSG_SQL})
""")
def q_message_delta(spark, sf_dir):
    m = conv_messages(spark, sf_dir)
    # Every message list is re-sent with the next event: each item arrives twice.
    snaps = m.withColumn("event_seq", F.col("idx")).unionByName(m.withColumn("event_seq", F.col("idx") + 1))
    d = runs.message_delta(snaps)
    return d.select("run_id", "idx", "event_seq", "sender", "recipient", F.md5("message").alias("message_md5"))


# --------------------------------------------------------------- guardrails --
CMD_BY_EVENT = (("view", "git status --short "), ("click", "rm -rf / --no-preserve-root #"),
                ("signup", "RM  -RF   /tmp/cache"), ("purchase", "git push origin main --force-with-lease "),
                ("error", "chmod -R 755 /srv/"))
CMD_SQL = (f"SELECT event_id, event_type, {_case('event_type', CMD_BY_EVENT)} || "
           "CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS cmd FROM events")


def commands(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long").cast("string")
    return e.select("event_id", "event_type", F.concat(F.expr(_case("event_type", CMD_BY_EVENT)), k).alias("cmd"))


def _rule_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, {q('(?i)' + p)}) THEN {i}"
                              for i, p in enumerate(rules.COMMAND_DENYLIST, 1)) + " END"


@query("command_audit", f"""
SELECT event_id, cmd, {_rule_sql('cmd')} AS rule_id, {_rule_sql('cmd')} IS NOT NULL AS blocked FROM ({CMD_SQL})
""")
def q_command_audit(spark, sf_dir):
    return guardrails.audit_commands(commands(spark, sf_dir)).select("event_id", "cmd", "rule_id", "blocked")


@query("payload_audit", f"""
WITH c AS ({CMD_SQL}),
p AS (SELECT event_id, to_json({{'tool': 'shell', 'cmd': CASE WHEN event_type = 'signup' THEN replace(cmd, ' ', chr(9)) ELSE cmd END}}) AS j FROM c)
SELECT event_id, {_rule_sql('CAST(j AS VARCHAR)')} AS rule_id, {_rule_sql('CAST(j AS VARCHAR)')} IS NOT NULL AS blocked FROM p
""")
def q_payload_audit(spark, sf_dir):
    c = commands(spark, sf_dir)
    cmd = F.when(F.col("event_type") == "signup", F.replace("cmd", F.lit(" "), F.lit("\t"))).otherwise(F.col("cmd"))
    p = c.select("event_id", F.struct(F.lit("shell").alias("tool"), cmd.alias("cmd")).alias("payload"))
    return guardrails.audit_payloads(p).select("event_id", "rule_id", "blocked")


_PAYLOAD_CMD = "CASE WHEN event_type IN ('signup', 'click') THEN replace(cmd, ' ', chr(9)) ELSE cmd END"


@query("payload_audit_strict", f"""
WITH c AS ({CMD_SQL}), p AS (SELECT event_id, cmd AS c0, {_PAYLOAD_CMD} AS cmd FROM c),
j AS (SELECT event_id, cmd, {_rule_sql("CAST(to_json({'tool': 'shell', 'args': {'note': 'n', 'cmds': ['ls', cmd]}}) AS VARCHAR)")} AS js, {_rule_sql('cmd')} AS raw FROM p)
SELECT event_id, least(js, raw) AS rule_id, least(js, raw) IS NOT NULL AS blocked, CASE WHEN raw = least(js, raw) THEN '$.args.cmds[1]' END AS blocked_at FROM j
""")
def q_payload_audit_strict(spark, sf_dir):
    """Commands in a nested payload, many with tabs for blanks: the values as they are count, too."""
    p = commands(spark, sf_dir).withColumn("cmd", F.expr(_PAYLOAD_CMD))
    args = F.struct(F.lit("n").alias("note"), F.array(F.lit("ls"), F.col("cmd")).alias("cmds"))
    p = p.select("event_id", F.struct(F.lit("shell").alias("tool"), args.alias("args")).alias("payload"))
    return guardrails.audit_payloads(p, strict=True).select("event_id", "rule_id", "blocked", "blocked_at")


# ------------------------------------------------ neighbours on ties ----
_TIED = "CASE WHEN user_id % 7 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 1 ELSE user_id % 50 END"


@query("neighbors_tied", f"""
WITH e AS (SELECT {_TIED} AS run_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE date_trunc('month', ts) END AS month, event_id, event_type FROM events)
SELECT coalesce(run_id, -1) AS run_id, event_id, coalesce(lag(event_id) OVER w, -1) AS prev_event_id, coalesce(lead(event_id) OVER w, -1) AS next_event_id,
       lag(event_type) OVER w AS prev_event_type, lead(event_type) OVER w AS next_event_type
FROM e WINDOW w AS (PARTITION BY run_id ORDER BY month NULLS FIRST, event_id)
""")
def q_neighbors_tied(spark, sf_dir):
    """Neighbours where many rows share an order value, keys and order values are null and one key holds a third of all rows."""
    from corpuslens.operators import sequence
    month = F.when(F.col("event_id") % 11 != 0, F.date_trunc("month", F.col("ts").cast("timestamp")))
    e = table(spark, sf_dir, "events").select(F.expr(_TIED).alias("run_id"), month.alias("month"), "event_id", "event_type")
    out = sequence.neighbors(e, "run_id", ["month"], ["event_id", "event_type"], partitions=50)
    none = F.lit(-1).cast("long")
    return out.select(*[F.coalesce(F.col(c).cast("long"), none).alias(c) for c in ("run_id", "event_id", "prev_event_id", "next_event_id")],
                      "prev_event_type", "next_event_type")
