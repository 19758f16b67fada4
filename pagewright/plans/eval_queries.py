"""Queries for the evaluation, over one case per document and three runs of each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import text as T
from pagewright.operators import evaluation as E
from pagewright.plans import oracle_views as V
from pagewright.plans.registry import query
from pagewright.session import cut_lineage, per_folder, shared_folder
from pagewright.sources import corpus as C
from pagewright.sources import files as I

VIEWS = V.VIEWS
M = C.DATA_MARKERS
STATUSES = ("completed", "completed", "not_found", "conflicting_evidence", "failed")
CODES = ("QA_STREAM_FAILED", "QA_FAILED", "CONNECTION_LOST", "REVISION_CHANGED", "OTHER")
EXPECTED = ("answered", "not_found", "answered", "answered", "answered", "answered", "conflicting_evidence", "answered", "insufficient_evidence")


@per_folder
def texts(spark, folder):
    return C.documents(spark, folder, "doc_id", "text").select(F.col("doc_id").alias("document_id"), F.col("text").alias("doc_text"))


@per_folder
def cases(spark, folder):
    d = F.col("document_id")
    numbers = F.slice(T.extract_numbers("doc_text"), 1, 1)
    first = F.split("doc_text", r"[ \n]", 2)[0]
    return texts(spark, folder).select(
        d.alias("case_id"), "document_id", C.pick(d % 9, S.EVAL_CATEGORIES).alias("category"), C.pick(d % 9, EXPECTED).alias("expected_status"),
        F.substring("doc_text", 1, 40).alias("question"), F.array(first).alias("required_evidence"),
        F.when(d % 4 == 1, F.array(F.lit(" the one"))).otherwise(F.array().cast("array<string>")).alias("forbidden_claims"),
        numbers.alias("expected_numbers"), F.when(d % 9 == 4, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>")).alias("expected_units"),
        F.when(d % 7 == 1, "negative").when(d % 7 == 2, "affirmative").when(d % 7 == 3, "maybe").alias("expected_polarity"),
        (d % 9 == 6).alias("expected_conflict"), F.when(d % 5 == 0, F.lit(3).cast("bigint")).when(d % 31 == 1, F.lit(-1).cast("bigint")).alias("max_claims"),
        (d % 3 == 0).alias("safety_critical"),
    )


VIEWS["o_cases"] = f"""SELECT doc_id AS case_id, doc_id AS document_id, text AS doc_text, {V.pick('doc_id % 9', S.EVAL_CATEGORIES)} AS category, {V.pick('doc_id % 9', EXPECTED)} AS expected_status,
 substr(text, 1, 40) AS question, [string_split_regex(text, '[ \\n]')[1]] AS required_evidence, CASE WHEN doc_id%4=1 THEN [' the one'] ELSE [] END AS forbidden_claims,
 {V.numbers('text')}[1:1] AS expected_numbers, CASE WHEN doc_id%9=4 THEN ['e'] ELSE [] END AS expected_units, CASE doc_id%7 WHEN 1 THEN 'negative' WHEN 2 THEN 'affirmative' WHEN 3 THEN 'maybe' END AS expected_polarity,
 doc_id%9=6 AS expected_conflict, CASE WHEN doc_id%5=0 THEN 3 WHEN doc_id%31=1 THEN -1 END AS max_claims, doc_id%3=0 AS safety_critical FROM documents"""


@per_folder
def runs(spark, folder):
    d, r = F.col("case_id"), F.col("run_index")
    base = texts(spark, folder).select(F.col("document_id").alias("case_id"), F.explode(F.array(*[F.lit(r).cast("bigint") for r in range(3)])).alias("run_index"))
    return base.withColumns({
        "status": C.pick((d + F.floor(r / 2)) % 5, STATUSES), "started": (d + r) % 23 != 1, "reached_terminal": (d + r) % 11 != 0, "timed_out": (d * 3 + r) % 29 == 0,
        "error_code": F.when((d + F.floor(r / 2)) % 5 == 4, C.pick((d + r) % 5, CODES)), "prestream_error": F.when((d + r) % 37 == 3, "503"),
        "latency": ((d * 37 + r * 11) % 1000) / 10, "retrieved_chunks": d % 3, "emitted_claims": (d + r) % 4, "rejected_claims": r,
    })


VIEWS["o_eruns"] = f"""SELECT *, {V.pick('(case_id + run_index//2) % 5', STATUSES)} AS status, (case_id+run_index)%23<>1 AS started, (case_id+run_index)%11<>0 AS reached_terminal, (case_id*3+run_index)%29=0 AS timed_out,
 CASE WHEN (case_id+run_index//2)%5=4 THEN {V.pick('(case_id + run_index) % 5', CODES)} END AS error_code, CASE WHEN (case_id+run_index)%37=3 THEN '503' END AS prestream_error,
 ((case_id*37+run_index*11)%1000)/10.0::DOUBLE AS latency, case_id%3 AS retrieved_chunks, (case_id+run_index)%4 AS emitted_claims, run_index AS rejected_claims FROM (SELECT doc_id AS case_id, unnest([0,1,2]) AS run_index FROM documents)"""


@per_folder
def claims(spark, folder):
    """Claims shown by each run: those over all pages of its document, of another kind in every run."""
    c = C.v_claims(spark, folder)
    kind = F.floor(F.col("claim_no") / 8)
    run = F.when(kind == 0, F.array(F.lit(0), F.lit(1))).when(kind == 5, F.array(F.lit(1), F.lit(2))).when(kind.isin(1, 4), F.array(F.lit(2))).otherwise(F.array(F.lit(1)))
    return c.select(F.col("document_id").alias("case_id"), F.explode(run.cast("array<bigint>")).alias("run_index"), (F.col("message_id") * 1000 + F.col("claim_no")).alias("claim_no"), "text", F.col("source_chunk_ids").alias("sources"))


VIEWS["o_eclaims"] = """SELECT document_id AS case_id, unnest(CASE claim_no//8 WHEN 0 THEN [0,1] WHEN 5 THEN [1,2] WHEN 1 THEN [2] WHEN 4 THEN [2] ELSE [1] END) AS run_index, claim_no, text, source_chunk_ids AS sources
FROM v_claims"""
VIEWS["o_eunknown"] = f"""SELECT case_id, list(num) AS unknown FROM (SELECT DISTINCT case_id, unnest({V.numbers('text')}) AS num FROM o_eclaims) JOIN o_cases USING (case_id)
WHERE NOT ({V.number_found('doc_text', 'num', 'eval')}) GROUP BY case_id"""
VIEWS["o_emarkers"] = f"""SELECT case_id, list_filter([{V.quoted(M)}], lambda mk: contains(padded_text, mk)) AS doc_markers FROM (SELECT case_id, {V.padded('doc_text')} AS padded_text FROM o_cases)"""
VIEWS["o_efacts"] = f"""SELECT case_id, run_index, count(*) AS claim_count, sum(len(sources))::BIGINT AS citation_count, bool_and(len(sources) > 0 AND len(list_filter(sources, lambda s: NOT list_contains(owned, s))) = 0) AS ownership,
 bool_and(len(list_filter(forbidden_claims, lambda b: contains(text, b))) = 0) AS forbidden,
 bool_and(len(list_filter({V.numbers('text')}, lambda n: list_contains(coalesce(unknown, []), n))) = 0) AS numbers,
 bool_and(len(list_filter({V.markers_in('text')}, lambda mk: NOT list_contains(doc_markers, mk))) = 0) AS polarity, bool_or(len({V.markers_in('text')}) > 0) AS negated, list(text) AS texts
FROM o_eclaims JOIN o_cases USING (case_id) JOIN o_emarkers USING (case_id) LEFT JOIN o_eunknown USING (case_id) JOIN (SELECT document_id, list(block_id) AS owned FROM v_blocks GROUP BY ALL) USING (document_id) GROUP BY case_id, run_index"""
SAID = f"len(list_filter(texts, lambda t: {V.number_found('t', 'n', 'eval')})) > 0"
PAIR = f"len(list_filter(texts, lambda t: contains(t, u) AND len(list_filter(expected_numbers, lambda n: {V.number_found('t', 'n', 'eval')})) > 0)) > 0"
JOINED = "array_to_string(texts, chr(10))"
VIEWS["o_checks"] = f"""
SELECT *, prestream_error IS NULL AND started AND reached_terminal AND NOT timed_out AS c_protocol,
 prestream_error IS NULL AND CASE WHEN expected_status='answered' THEN status='completed' WHEN expected_status IN ('not_found','insufficient_evidence') THEN status IN ('not_found','insufficient_evidence') ELSE status=expected_status END AS c_status,
 pre OR coalesce(ownership, true) AS c_ownership, pre OR coalesce(forbidden, true) AS c_forbidden, pre OR coalesce(numbers, true) AS c_numbers, pre OR coalesce(polarity, true) AS c_polarity,
 pre OR CASE WHEN expected_polarity IS NULL OR status<>'completed' OR n=0 THEN true WHEN expected_polarity='negative' THEN negated ELSE NOT negated END AS c_expected_polarity,
 pre OR status<>'completed' OR len(list_filter(expected_numbers, lambda n: NOT ({SAID}))) = 0 AS c_expected_numbers,
 pre OR status<>'completed' OR len(list_filter(expected_units, lambda u: NOT (CASE WHEN len(expected_numbers) > 0 THEN {PAIR} ELSE contains({JOINED}, u) END))) = 0 AS c_units,
 pre OR NOT expected_conflict OR (status='conflicting_evidence' AND k >= 2) AS c_conflict,
 pre OR status<>'completed' OR len(list_filter(required_evidence, lambda e: NOT contains({JOINED}, e))) = 0 AS c_evidence, pre OR max_claims IS NULL OR n <= max_claims AS c_claims_cap
FROM (SELECT r.*, c.* EXCLUDE (case_id), f.ownership, f.forbidden, f.numbers, f.polarity, f.negated, coalesce(f.texts, []) AS texts, coalesce(f.claim_count, 0) AS n, coalesce(f.citation_count, 0) AS k, prestream_error IS NOT NULL AS pre
 FROM o_eruns r JOIN o_cases c ON c.case_id=r.case_id LEFT JOIN o_efacts f ON f.case_id=r.case_id AND f.run_index=r.run_index)"""
ALL_OK = " AND ".join(f"c_{c}" for c in S.EVAL_CHECKS)
SAFE_OK = " AND ".join(f"c_{c}" for c in S.SAFETY_CHECKS)
VIEWS["o_eval"] = f"""
SELECT * REPLACE (CASE WHEN pre THEN 'prestream_error' ELSE status END AS status, CASE WHEN pre THEN 0 ELSE n END AS n, CASE WHEN pre THEN 0 ELSE k END AS k), {ALL_OK} AS passed, NOT ({SAFE_OK}) AS explicit,
 safety_critical AND NOT ({ALL_OK}) AND ({SAFE_OK}) AS critical,
 CASE WHEN {ALL_OK} THEN NULL WHEN pre THEN 'provider_protocol' WHEN timed_out THEN 'timeout' WHEN NOT started OR NOT reached_terminal THEN 'provider_protocol'
  WHEN status='failed' THEN CASE WHEN error_code IN ('QA_STREAM_FAILED','QA_FAILED','CONNECTION_LOST') THEN 'provider_protocol' ELSE 'internal_error' END WHEN NOT c_conflict THEN 'conflict_not_detected'
  WHEN NOT c_status THEN CASE WHEN expected_conflict AND status='completed' THEN 'conflict_not_detected' WHEN held AND retrieved_chunks=0 THEN 'retrieval_empty' WHEN held AND emitted_claims=0 THEN 'malformed_output'
    WHEN held AND rejected_claims>0 AND n=0 THEN 'claim_rejected' ELSE 'status_mismatch' END
  WHEN NOT c_expected_polarity THEN CASE WHEN category='direction' THEN 'direction_mismatch' ELSE 'polarity_mismatch' END WHEN NOT c_evidence THEN 'evidence_missing' WHEN NOT (c_numbers AND c_units) THEN 'number_or_unit_mismatch'
  WHEN NOT c_ownership THEN 'unsupported_claim' WHEN NOT c_forbidden THEN 'forbidden_exposed' WHEN NOT c_claims_cap THEN 'too_many_claims' ELSE 'status_mismatch' END AS failure_category,
 CASE WHEN pre THEN NULL WHEN timed_out THEN 'timeout' WHEN error_code IS NULL THEN NULL WHEN error_code='QA_STREAM_FAILED' THEN 'provider_stream_error' WHEN error_code='QA_FAILED' THEN 'provider_error'
  WHEN error_code='CONNECTION_LOST' THEN 'connection_lost' WHEN error_code='REVISION_CHANGED' THEN 'revision_changed' WHEN error_code='CONSENT_REVOKED' THEN 'consent_revoked' ELSE 'internal_error' END AS provider_error
FROM (SELECT *, expected_status='answered' AND status IN ('not_found','insufficient_evidence') AS held FROM o_checks)"""
VIEWS["o_agg"] = """SELECT case_id, min(category) AS category, bool_or(safety_critical) AS safety_critical, count(*) AS runs, count(*) FILTER (passed) AS passes, round_even(count(*) FILTER (passed)/count(*), 4) AS pass_rate,
 count(DISTINCT passed) > 1 OR count(DISTINCT status) > 1 AS unstable, bool_or(explicit OR critical) AS safety_failed, bool_or(explicit) AS explicit, bool_or(critical) AS critical,
 count(*) FILTER (passed)=count(*) AND NOT bool_or(explicit OR critical) AS final_pass, arg_max(n, run_index) AS claim_count, arg_max(k, run_index) AS citation_count, arg_max(status, run_index) AS last_status, round_even(sum(latency)/count(*), 3) AS mean_latency, string_agg(status, ';' ORDER BY run_index) AS statuses
FROM o_eval GROUP BY case_id"""
VIEWS["o_broken"] = f"""SELECT case_id, string_agg(c, ';' ORDER BY first_run, pos) AS violations FROM (SELECT case_id, c, pos, min(run_index) AS first_run FROM ({" UNION ALL ".join(f"SELECT case_id, run_index, '{c}' AS c, {i} AS pos FROM o_eval WHERE NOT c_{c}" for i, c in enumerate(S.SAFETY_CHECKS))}) GROUP BY ALL) GROUP BY case_id"""
VIEWS["o_rates"] = "SELECT category, round_even(avg(final_pass::INT::DOUBLE), 4) AS pass_rate FROM o_agg GROUP BY ALL"
ANS = V.quoted(S.ANSWERABLE_CATEGORIES)
VIEWS["o_sum"] = f"""SELECT e.*, a.* FROM (SELECT count(*) AS total_runs, round_even(count(*) FILTER (c_protocol)/count(*), 4) AS protocol_rate, round_even(count(*) FILTER (c_status)/count(*), 4) AS status_accuracy,
 CASE WHEN count(*) FILTER (category IN ({ANS}))=0 THEN 1.0 ELSE round_even(count(*) FILTER (category IN ({ANS}) AND status='completed' AND passed)/count(*) FILTER (category IN ({ANS})), 4) END::DOUBLE AS answerable_valid,
 CASE WHEN count(*) FILTER (category='not_found')=0 THEN 1.0 ELSE round_even(count(*) FILTER (category='not_found' AND status IN ('not_found','insufficient_evidence'))/count(*) FILTER (category='not_found'), 4) END::DOUBLE AS not_found_hold,
 list_sort(list(round_even(latency,3)))[round_even(0.5*(count(*)-1),0)::BIGINT+1] AS latency_p50, list_sort(list(round_even(latency,3)))[round_even(0.95*(count(*)-1),0)::BIGINT+1] AS latency_p95 FROM o_eval) e
 CROSS JOIN (SELECT count(*) AS total_cases, count(*) FILTER (safety_failed) AS safety_failure_cases, count(*) FILTER (explicit) AS explicit_cases, count(*) FILTER (critical) AS critical_cases, count(*) FILTER (unstable) AS unstable_cases, min(runs) AS repeat FROM o_agg) a"""
CATS = V.quoted(S.EVAL_CATEGORIES)
VIEWS["o_gate"] = f"""SELECT array_to_string(list_filter(g, lambda x: x IS NOT NULL), ';') AS failures, explicit_cases=0 AS explicit_passed, critical_cases=0 AS critical_passed, len(missing)=0 AND repeat >= {S.MIN_RELEASE_REPEAT} AS coverage_complete,
 len(list_filter(g, lambda x: x IS NOT NULL AND x NOT IN ('explicit_violation','critical_failure')))=0 AS model_gate_passed FROM (
 SELECT *, [CASE WHEN explicit_cases>0 THEN 'explicit_violation' END, CASE WHEN critical_cases>0 THEN 'critical_failure' END, CASE WHEN len(missing)>0 THEN 'missing:'||array_to_string(missing, ',') END,
  CASE WHEN repeat < {S.MIN_RELEASE_REPEAT} THEN 'too_few_repeats' END, CASE WHEN protocol_rate < {S.GATE_PROTOCOL} THEN 'protocol' END, CASE WHEN status_accuracy < {S.GATE_STATUS} THEN 'status' END, CASE WHEN answerable_valid < {S.GATE_ANSWERABLE} THEN 'answerable' END,
  CASE WHEN not_found_hold < {S.GATE_HOLD} THEN 'hold' END, {", ".join(f"(SELECT CASE WHEN max(pass_rate) IS NULL THEN 'core_missing:{c}' WHEN max(pass_rate) < 1 THEN 'core_below:{c}' END FROM o_rates WHERE category='{c}')" for c in S.CORE_CATEGORIES)}] AS g
 FROM (SELECT *, coalesce((SELECT list_sort(list(c)) FROM (SELECT unnest([{CATS}]) AS c) WHERE c NOT IN (SELECT category FROM o_rates)), []) AS missing FROM o_sum))"""


@per_folder
def results(spark, folder):
    return E.evaluate_runs(cases(spark, folder), runs(spark, folder), claims(spark, folder), texts(spark, folder), C.v_blocks(spark, folder), M)


@per_folder
def stored_results(spark, folder):
    """Run results as the roll-ups read them: written once, then scanned several times."""
    return cut_lineage(results(spark, folder))


@per_folder
def rolled(spark, folder):
    return E.aggregate_cases(stored_results(spark, folder))


@per_folder
def summary(spark, folder):
    return E.eval_summary(stored_results(spark, folder), rolled(spark, folder))


@per_folder
def gate(spark, folder):
    return E.release_gate(summary(spark, folder), E.category_rates(rolled(spark, folder)))


UNIT_PAIR = rf"len(list_filter(expected_numbers, lambda n: len(list_filter(expected_units, lambda u: regexp_matches(doc_text, '(^|[^0-9])'||replace(regexp_replace(n,'[,%]','','g'),'.','\.')||'[{T.SPACE_RE2}]*'||regexp_escape(u)))) > 0)) > 0"


@query("validate_eval_cases", f"""SELECT case_id, unnest(list_filter([CASE WHEN expected_polarity NOT IN ('affirmative','negative') THEN 'unknown_polarity' END, CASE WHEN max_claims < 0 THEN 'negative_claim_cap' END,
 CASE WHEN {V.blank('question')} THEN 'blank_question' END, CASE WHEN len(list_filter(expected_numbers, lambda n: NOT ({V.number_found('doc_text', 'n', 'eval')}))) > 0 THEN 'number_missing' END,
 CASE WHEN len(list_filter(expected_units, lambda u: NOT contains(doc_text, u))) > 0 THEN 'unit_missing' END, CASE WHEN category='unit' AND (len(expected_numbers)=0 OR len(expected_units)=0) THEN 'unit_case_incomplete' END,
 CASE WHEN category='unit' AND NOT ({UNIT_PAIR}) THEN 'unit_pair_missing' END, CASE WHEN expected_conflict AND NOT safety_critical THEN 'conflict_not_critical' END], lambda x: x IS NOT NULL)) AS rule FROM o_cases""")
def _validate_eval_cases(spark, folder):
    return E.validate_eval_cases(cases(spark, folder), texts(spark, folder))


CHECK_SQL = ", ".join(f"c_{c} AS check_{c}" for c in S.EVAL_CHECKS)


@query("evaluate_runs", f"SELECT case_id, run_index::BIGINT AS run_index, status, n AS claim_count, k AS citation_count, passed, {CHECK_SQL} FROM o_eval")
def _evaluate_runs(spark, folder):
    return results(spark, folder).select("case_id", "run_index", "status", "claim_count", "citation_count", "passed", *[f"check_{c}" for c in S.EVAL_CHECKS])


@query("error_categories", "SELECT case_id, run_index::BIGINT AS run_index, provider_error FROM o_eval")
def _error_categories(spark, folder):
    return runs(spark, folder).select("case_id", "run_index", E.error_categories().alias("provider_error"))


@query("safety_split", "SELECT case_id, run_index::BIGINT AS run_index, explicit, critical FROM o_eval")
def _safety_split(spark, folder):
    return results(spark, folder).select("case_id", "run_index", "explicit", "critical")


@query("failure_category", "SELECT case_id, run_index::BIGINT AS run_index, failure_category FROM o_eval")
def _failure_category(spark, folder):
    return results(spark, folder).select("case_id", "run_index", "failure_category")


@query("aggregate_cases", "SELECT a.*, coalesce(violations, '') AS violations FROM o_agg a LEFT JOIN o_broken USING (case_id)")
def _aggregate_cases(spark, folder):
    return rolled(spark, folder).withColumns({c: F.array_join(c, ";") for c in ("statuses", "violations")})


@query("eval_summary", "SELECT * FROM o_sum")
def _eval_summary(spark, folder):
    return summary(spark, folder)


@query("category_rates", "SELECT * FROM o_rates")
def _category_rates(spark, folder):
    return E.category_rates(rolled(spark, folder))


@query("release_gate", "SELECT * FROM o_gate")
def _release_gate(spark, folder):
    return gate(spark, folder).withColumn("failures", F.array_join("failures", ";"))


POLICY = (("base", "default_recommended", "release_hold", "release_hold"), ("light", "selectable", "light_limited", "allowlist_excluded"),
          ("large", "selectable", "release_hold", "release_hold"), ("other", None, None, None))


@query("gate_verdict", """SELECT p.model, CASE WHEN NOT explicit_passed THEN coalesce(v, 'release_hold') WHEN NOT critical_passed OR NOT coverage_complete THEN 'release_hold' WHEN model_gate_passed THEN coalesce(a, 'release_hold') ELSE coalesce(b, 'release_hold') END AS verdict
FROM o_gate CROSS JOIN (VALUES ('base','default_recommended','release_hold','release_hold'), ('light','selectable','light_limited','allowlist_excluded'), ('large','selectable','release_hold','release_hold'), ('other',NULL,NULL,NULL)) p(model, a, b, v)""")
def _gate_verdict(spark, folder):
    policy = spark.createDataFrame(POLICY, "model string, on_pass string, on_fail string, on_violation string")
    gates = gate(spark, folder).withColumn("model", F.explode(F.array(*[F.lit(p[0]) for p in POLICY])))
    return E.gate_verdict(gates, policy).select("model", "verdict")


@query("eval_report", """SELECT 'case' AS section, case_id::VARCHAR AS name, category||'|'||runs||'|'||passes||'|'||final_pass AS value FROM o_agg
UNION ALL SELECT 'category', category, pass_rate::DECIMAL(6,4)::VARCHAR FROM o_rates
UNION ALL SELECT 'gate', unnest(['failures','explicit_passed','critical_passed','coverage_complete','model_gate_passed']), unnest([failures, explicit_passed::VARCHAR, critical_passed::VARCHAR, coverage_complete::VARCHAR, model_gate_passed::VARCHAR]) FROM o_gate
UNION ALL SELECT 'summary', unnest(['total_runs','protocol_rate','status_accuracy','answerable_valid','not_found_hold','total_cases','safety_failure_cases','explicit_cases','critical_cases','unstable_cases','repeat']),
 unnest([total_runs::VARCHAR, protocol_rate::VARCHAR, status_accuracy::VARCHAR, answerable_valid::VARCHAR, not_found_hold::VARCHAR, total_cases::VARCHAR, safety_failure_cases::VARCHAR, explicit_cases::VARCHAR, critical_cases::VARCHAR, unstable_cases::VARCHAR, repeat::VARCHAR]) FROM o_sum""")
def _eval_report(spark, folder):
    return E.eval_report(summary(spark, folder), gate(spark, folder), rolled(spark, folder), E.category_rates(rolled(spark, folder)))


FAILED = "list_filter([" + ", ".join(f"CASE WHEN NOT c_{c} THEN '{c}' END" for c in S.EVAL_CHECKS) + "], lambda x: x IS NOT NULL)"


@query("case_reports", f"""SELECT a.case_id, to_json(struct_pack(caseId := a.case_id, category := a.category, safetyCritical := a.safety_critical, runs := a.runs, passes := a.passes, passRate := a.pass_rate,
 statuses := string_split(a.statuses, ';'), answerStatus := a.last_status, claimCount := a.claim_count, citationCount := a.citation_count, latencySec := a.mean_latency, unstable := a.unstable,
 safetyFailed := a.safety_failed, explicitSafetyViolation := a.explicit, criticalCaseFailure := a.critical, safetyViolations := CASE WHEN b.violations IS NULL THEN [] ELSE string_split(b.violations, ';') END,
 finalPass := a.final_pass, runDiagnostics := e.runs))::VARCHAR AS report
FROM o_agg a LEFT JOIN o_broken b USING (case_id) JOIN (SELECT case_id, list(struct_pack(runIndex := run_index::BIGINT, passed := passed, failedChecks := {FAILED}, terminalStatus := status, failureCategory := failure_category,
 providerErrorCategory := provider_error, claimCount := n, citationCount := k, latencySec := latency, explicitSafetyViolation := explicit, criticalCaseFailure := critical) ORDER BY run_index) AS runs FROM o_eval GROUP BY case_id) e USING (case_id)""")
def _case_reports(spark, folder):
    return E.case_reports(rolled(spark, folder), stored_results(spark, folder))


@query("read_eval_cases", """SELECT case_id, category, expected_status, question, array_to_string(required_evidence, '|') AS evidence, array_to_string(forbidden_claims, '|') AS forbidden,
 array_to_string(expected_numbers, '|') AS numbers, array_to_string(expected_units, '|') AS units, expected_polarity, expected_conflict, max_claims, safety_critical FROM o_cases""")
def _read_eval_cases(spark, folder):
    """Cases written as JSON lines, under the names that a file of cases has, and read again."""
    names = {"category": "category", "expected_status": "expectedStatus", "question": "question", "required_evidence": "requiredEvidence", "forbidden_claims": "forbiddenClaims",
             "expected_numbers": "expectedNumbers", "expected_units": "expectedUnits", "expected_polarity": "expectedPolarity", "expected_conflict": "expectedConflict",
             "max_claims": "maximumAcceptedClaims", "safety_critical": "safetyCritical"}
    files = f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    cases(spark, folder).select(F.col("case_id").cast("string").alias("caseId"), *[F.col(c).alias(n) for c, n in names.items()]).write.json(files)
    lists = {"required_evidence": "evidence", "forbidden_claims": "forbidden", "expected_numbers": "numbers", "expected_units": "units"}
    read = I.read_eval_cases(spark, files)
    columns = [F.array_join(n, "|").alias(lists[c]) if c in lists else F.col(n).alias(c) for c, n in names.items()]
    return read.select(F.col("caseId").cast("bigint").alias("case_id"), *columns)
