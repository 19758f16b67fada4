"""Answer-quality evaluation: checks per run, roll-up per case, summary rates and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import text as T


def validate_eval_cases(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """Violations of every case as rows (case_id, rule).  `texts` are (document_id, doc_text)."""
    copies = cases.groupBy("case_id").agg(F.count(F.lit(1)).alias("copies"))
    df = cases.join(copies, "case_id").join(texts, "document_id", "left")
    text = F.col("doc_text")
    numbers, units = F.col("expected_numbers"), F.col("expected_units")
    paired = F.exists(numbers, lambda n: F.exists(units, lambda u: T.value_unit_adjacent(text, n, u)))
    unit_case = F.col("category") == "unit"
    rules = {
        "duplicate_id": F.col("copies") > 1,
        "unknown_category": ~F.coalesce(F.col("category").isin(*S.EVAL_CATEGORIES), F.lit(False)),
        "unknown_status": ~F.coalesce(F.col("expected_status").isin(*S.EVAL_STATUSES), F.lit(False)),
        "unknown_fixture": text.isNull(),
        "blank_question": T.is_blank("question"),
        "unknown_polarity": F.col("expected_polarity").isNotNull() & ~F.col("expected_polarity").isin("affirmative", "negative"),
        "negative_claim_cap": F.coalesce(F.col("max_claims") < 0, F.lit(False)),
        "evidence_missing": F.exists("required_evidence", lambda e: ~text.contains(e)),
        "number_missing": F.exists(numbers, lambda n: ~T.number_in_text(text, n, "eval")),
        "unit_missing": F.exists(units, lambda u: ~text.contains(u)),
        "unit_case_incomplete": unit_case & ((F.size(numbers) == 0) | (F.size(units) == 0)),
        "unit_pair_missing": unit_case & ~paired,
        "conflict_not_critical": F.col("expected_conflict") & ~F.col("safety_critical"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select("case_id", F.explode(broken).alias("rule")).distinct()


def error_categories(code="error_code", timed_out="timed_out", prestream="prestream_error") -> Column:
    """Safe category of a provider failure."""
    c = T.col(code)
    return (
        F.when(T.col(prestream).isNotNull(), F.lit(None).cast("string"))
        .when(T.col(timed_out), "timeout").when(c.isNull(), F.lit(None).cast("string"))
        .when(c == "QA_STREAM_FAILED", "provider_stream_error").when(c == "QA_FAILED", "provider_error")
        .when(c == "CONNECTION_LOST", "connection_lost").when(c == "REVISION_CHANGED", "revision_changed")
        .when(c == "CONSENT_REVOKED", "consent_revoked").otherwise("internal_error")
    )


def _status_ok() -> Column:
    """Server statuses accepted for each expected status."""
    e, s = F.col("expected_status"), F.col("status")
    held = s.isin("not_found", "insufficient_evidence")
    return (
        F.when(e == "answered", s == "completed").when(e.isin("not_found", "insufficient_evidence"), held)
        .otherwise(s == e)
    )


#: Shares that the claims of a case are dealt into; a case's few fields are repeated that often.
CLAIM_SHARES = 16


def _number_keys(plain: Column) -> Column:
    """Forms under which a text without commas holds numbers for the eval rule (see T.number_in_text).

    A number is found where a chain of digits and points ends: its last part, or its last two, with a percent sign or not.
    """
    ends = F.regexp_extract_all(plain, F.lit(r"(?<!\p{Nd})(?:\p{Nd}+\.)?\p{Nd}+(?!\p{Nd})(?!\.\p{Nd})%?"), 0)
    forms = F.flatten(F.transform(ends, lambda e: F.array(e, F.regexp_replace(e, r"^.*\.", ""), F.regexp_replace(e, "%", ""), F.regexp_replace(e, r"^.*\.|%", ""))))
    return F.array_distinct(forms)


def _unknown(mentions: DataFrame, known: DataFrame, keys: list[str], name: str) -> DataFrame:
    """case_id, run_index, and how many of a run's mentions are not among the known ones.

    Mentions are counted before they are moved, so that one said in every claim is one row for each run.
    """
    counted = mentions.groupBy("case_id", "run_index", *keys).agg(F.count(F.lit(1)).alias("said"))
    met = counted.join(known.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left")
    return met.filter("known is null").groupBy("case_id", "run_index").agg(F.sum("said").alias(name))


def _claim_facts(claims: DataFrame, cases: DataFrame, texts: DataFrame, blocks: DataFrame, markers) -> DataFrame:
    """What the checks need of the claims of each run, however many there are.

    Numbers and sources of claims are counted per run and meet those of the document by value, so that no claim meets a
    whole text; texts of claims are looked at one by one, and only what was found of the case's few expectations is kept.
    """
    shared = ["case_id", "forbidden_claims", "expected_numbers", "expected_units", "required_evidence"]
    marked = texts.select("document_id", T.negation_markers("doc_text", markers).alias("doc_markers"))
    fields = cases.join(marked, "document_id").select("document_id", *shared, "doc_markers", F.explode(F.sequence(F.lit(0), F.lit(CLAIM_SHARES - 1))).alias("share"))
    share = F.pmod(F.xxhash64("case_id", "run_index", "claim_no"), F.lit(CLAIM_SHARES)).cast("int")
    df = claims.withColumns({"share": share, "numbers": T.extract_numbers("text"), "marks": T.negation_markers("text", markers)}).join(fields, ["case_id", "share"])
    text, nums = F.col("text"), F.col("expected_numbers")

    def said(n):
        return T.number_in_text(text, n, "eval")

    found = df.select(
        "case_id", "run_index", "sources", "marks", "doc_markers",
        F.exists("forbidden_claims", lambda b: (b != "") & text.contains(b)).alias("bad"),
        F.filter(nums, said).alias("said"),
        F.filter("expected_units", lambda u: text.contains(u) & ((F.size(nums) == 0) | F.exists(nums, said))).alias("units"),
        F.filter("required_evidence", lambda e: text.contains(e)).alias("evidence"),
    )

    def all_found(name):
        return F.array_distinct(F.flatten(F.collect_set(name))).alias(name + "_found")

    out = found.groupBy("case_id", "run_index").agg(
        F.count(F.lit(1)).alias("claim_count"), F.sum(F.greatest(F.size("sources"), F.lit(0))).alias("citation_count"),
        F.bool_and(F.coalesce(F.size("sources") > 0, F.lit(False))).alias("cited"), F.bool_and(~F.col("bad")).alias("forbidden"),
        F.bool_and(F.size(F.array_except("marks", "doc_markers")) == 0).alias("polarity"), F.bool_or(F.size("marks") > 0).alias("negated"),
        all_found("said"), all_found("units"), all_found("evidence"),
    )
    of = claims.join(cases.select("case_id", "document_id"), "case_id")
    numbers = of.select("case_id", "run_index", "document_id", F.explode(T.extract_numbers("text")).alias("n")).withColumn("key", F.replace("n", F.lit(","), F.lit("")))
    held = texts.select("document_id", F.explode(_number_keys(F.replace("doc_text", F.lit(","), F.lit("")))).alias("key"))
    sources = of.select("case_id", "run_index", "document_id", F.explode("sources").alias("source"))
    own = blocks.select("document_id", F.col("block_id").alias("source"))
    out = out.join(_unknown(numbers, held, ["document_id", "key"], "unknown_numbers"), ["case_id", "run_index"], "left")
    out = out.join(_unknown(sources, own, ["document_id", "source"], "foreign"), ["case_id", "run_index"], "left")
    return out.withColumns({"numbers": F.col("unknown_numbers").isNull(), "ownership": F.col("cited") & F.col("foreign").isNull()}).drop("cited", "foreign")


def evaluate_runs(cases: DataFrame, runs: DataFrame, claims: DataFrame, texts: DataFrame, blocks: DataFrame, markers=S.NEGATION_MARKERS) -> DataFrame:
    """Twelve checks per run, with pass, safety split and failure category.

    What a run must say (numbers, units with a number, evidence) has to stand in one of its claims.
    """
    df = runs.join(cases, "case_id").join(_claim_facts(claims, cases, texts, blocks, markers), ["case_id", "run_index"], "left")
    yes, zero, none = F.lit(True), F.lit(0).cast("bigint"), F.array().cast("array<string>")
    df = df.withColumns(
        {
            "claim_count": F.coalesce("claim_count", zero), "citation_count": F.coalesce("citation_count", zero), "unknown_numbers": F.coalesce("unknown_numbers", zero),
            **{c: F.coalesce(c, none) for c in ("said_found", "units_found", "evidence_found")},
            **{c: F.coalesce(c, yes) for c in ("ownership", "forbidden", "numbers", "polarity")}, "negated": F.coalesce("negated", F.lit(False)),
        }
    )
    nums, units, done = F.col("expected_numbers"), F.col("expected_units"), F.col("status") == "completed"

    def all_in(wanted, found, blank_holds=F.lit(False)):
        return F.forall(wanted, lambda x: F.array_contains(found, x) | ((x == "") & blank_holds))

    polar = F.col("expected_polarity").isNotNull() & done & (F.col("claim_count") > 0)
    checks = {
        "protocol": F.col("started") & F.col("reached_terminal") & ~F.col("timed_out"),
        "status_ok": _status_ok(),
        "ownership": F.col("ownership"), "forbidden": F.col("forbidden"), "numbers": F.col("numbers"), "polarity": F.col("polarity"),
        "expected_polarity_ok": F.when(~polar, True).when(F.col("expected_polarity") == "negative", F.col("negated")).otherwise(~F.col("negated")),
        "expected_numbers_ok": F.when(~done, True).otherwise(all_in(nums, "said_found")),
        "units": F.when(~done, True).otherwise(all_in(units, "units_found", F.size(nums) == 0)),
        "conflict": ~F.col("expected_conflict") | ((F.col("status") == "conflicting_evidence") & (F.col("citation_count") >= 2)),
        "evidence": F.when(~done, True).otherwise(all_in("required_evidence", "evidence_found", yes)),
        "claims_cap": F.col("max_claims").isNull() | (F.col("claim_count") <= F.col("max_claims")),
    }
    refused = F.col("prestream_error").isNotNull()
    names = list(checks)
    # a run refused before it started fails the protocol; nothing else was observed (its status counts as not met)
    df = df.withColumns({"k_" + n: F.when(refused, F.lit(n not in ("protocol", "status_ok"))).otherwise(F.coalesce(c, F.lit(False))) for n, c in checks.items()})
    df = df.withColumns({"status": F.when(refused, "prestream_error").otherwise(F.col("status")),
                         "claim_count": F.when(refused, zero).otherwise(F.col("claim_count")), "citation_count": F.when(refused, zero).otherwise(F.col("citation_count"))})
    everything = F.lit(True)
    for n in names:
        everything = everything & F.col("k_" + n)
    df = df.withColumn("passed", everything)
    df = df.withColumns({"explicit": safety_split(), "failure_category": failure_category()})
    df = df.withColumn("critical", F.col("safety_critical") & ~F.col("passed") & ~F.col("explicit"))
    df = df.withColumn("provider_error", error_categories())
    rest = ["case_id", "run_index", "category", "safety_critical", "status", "claim_count", "citation_count", "latency", "passed", "explicit", "critical", "failure_category",
            "provider_error"]
    return df.select(*rest, *[F.col("k_" + n).alias("check_" + n.removesuffix("_ok")) for n in names])


def safety_split() -> Column:
    """Explicit violation: any of the six safety checks failed."""
    bad = F.lit(False)
    for n in ("ownership", "forbidden", "numbers", "polarity", "units", "expected_polarity_ok"):
        bad = bad | ~F.col("k_" + n)
    return bad


def failure_category() -> Column:
    """One safe cause for a failed run, in fixed order."""

    def bad(n):
        return ~F.col("k_" + n)

    s = F.col("status")
    held = (F.col("expected_status") == "answered") & s.isin("not_found", "insufficient_evidence")
    status = (
        F.when(F.col("expected_conflict") & (s == "completed"), "conflict_not_detected")
        .when(held & (F.col("retrieved_chunks") == 0), "retrieval_empty")
        .when(held & (F.col("emitted_claims") == 0), "malformed_output")
        .when(held & (F.col("rejected_claims") > 0) & (F.col("claim_count") == 0), "claim_rejected")
        .otherwise("status_mismatch")
    )
    provider = F.coalesce(F.col("error_code").isin("QA_STREAM_FAILED", "QA_FAILED", "CONNECTION_LOST"), F.lit(False))
    return (
        F.when(F.col("passed"), F.lit(None).cast("string"))
        .when(F.col("prestream_error").isNotNull(), "provider_protocol")
        .when(F.col("timed_out"), "timeout")
        .when(~F.col("started") | ~F.col("reached_terminal"), "provider_protocol")
        .when(s == "failed", F.when(provider, "provider_protocol").otherwise("internal_error"))
        .when(bad("protocol"), "provider_protocol")
        .when(bad("conflict"), "conflict_not_detected")
        .when(bad("status_ok"), status)
        .when(bad("expected_polarity_ok"), F.when(F.col("category") == "direction", "direction_mismatch").otherwise("polarity_mismatch"))
        .when(bad("evidence"), "evidence_missing")
        .when(bad("numbers") | bad("units"), "number_or_unit_mismatch")
        .when(bad("ownership"), "unsupported_claim")
        .when(bad("forbidden"), "forbidden_exposed")
        .when(bad("claims_cap"), "too_many_claims")
        .otherwise("status_mismatch")
    )


def aggregate_cases(results: DataFrame) -> DataFrame:
    """Roll-up of the repeats of every case; one failing repeat is never averaged away.

    `statuses` are those of the repeats in order, `violations` the safety checks that any of them failed, each once, in the
    order in which they were first seen.  A case has a few repeats.
    """
    broken = F.array_compact(F.array(*[F.when(~F.col(f"check_{c}"), F.lit(c)) for c in S.SAFETY_CHECKS]))
    failed = F.col("explicit") | F.col("critical")
    last = F.max(F.struct("run_index", "claim_count", "citation_count", "status")).alias("last")
    df = results.groupBy("case_id").agg(
        F.min("category").alias("category"), F.bool_or("safety_critical").alias("safety_critical"),
        F.count(F.lit(1)).alias("runs"), F.count(F.when(F.col("passed"), 1)).alias("passes"),
        F.min("status").alias("lowest_status"), F.max("status").alias("highest_status"),
        F.bool_or(failed).alias("safety_failed"), F.bool_or("explicit").alias("explicit"), F.bool_or("critical").alias("critical"),
        F.array_sort(F.collect_list(F.struct("run_index", "status", broken.alias("broken")))).alias("each"),
        last, F.bround(F.sum("latency") / F.count(F.lit(1)), 3).alias("mean_latency"),
    )
    mixed = ((F.col("passes") > 0) & (F.col("passes") < F.col("runs"))) | (F.col("lowest_status") != F.col("highest_status"))
    return df.select(
        "case_id", "category", "safety_critical", "runs", "passes", F.bround(F.col("passes") / F.col("runs"), 4).alias("pass_rate"),
        mixed.alias("unstable"), "safety_failed", "explicit", "critical",
        ((F.col("passes") == F.col("runs")) & ~F.col("safety_failed")).alias("final_pass"),
        F.col("last.claim_count").alias("claim_count"), F.col("last.citation_count").alias("citation_count"),
        F.col("last.status").alias("last_status"), "mean_latency", F.col("each.status").alias("statuses"),
        F.array_distinct(F.flatten("each.broken")).alias("violations"),
    )


def category_rates(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.bround(F.avg(F.col("final_pass").cast("double")), 4).alias("pass_rate"))


def _nearest_ranks(latencies: DataFrame, **ranks: float) -> DataFrame:
    """Nearest-rank percentiles, one row.  Latencies are rounded to milliseconds and limited by the answer
    deadline, so their distinct values stay few however many runs there are."""
    counts = latencies.groupBy(F.bround("latency", 3).alias("latency")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("latency").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(everything)})

    def at(p):
        return F.least(F.bround(F.lit(p) * (F.col("total") - 1), 0) + 1, F.col("total"))

    return df.agg(*[F.min(F.when(F.col("upto") >= at(p), F.col("latency"))).alias(name) for name, p in ranks.items()])


def eval_summary(results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of rates; an empty denominator counts as met for the two optional rates."""
    n = F.count(F.lit(1))

    def count(cond):
        return F.count(F.when(cond, 1))

    answerable = F.col("category").isin(*S.ANSWERABLE_CATEGORIES)
    absent = F.col("category") == "not_found"
    held = F.col("status").isin("not_found", "insufficient_evidence")

    def rate(good, base, empty):
        return F.when(base == 0, F.lit(empty)).otherwise(F.bround(good / base, 4))

    rates = results.agg(
        n.alias("total_runs"), rate(count(F.col("check_protocol")), n, 0.0).alias("protocol_rate"),
        rate(count(F.col("check_status")), n, 0.0).alias("status_accuracy"),
        rate(count(answerable & (F.col("status") == "completed") & F.col("passed")), count(answerable), 1.0).alias("answerable_valid"),
        rate(count(absent & held), count(absent), 1.0).alias("not_found_hold"),
    )
    rolled = cases.agg(
        n.alias("total_cases"), count(F.col("safety_failed")).alias("safety_failure_cases"), count(F.col("explicit")).alias("explicit_cases"),
        count(F.col("critical")).alias("critical_cases"), count(F.col("unstable")).alias("unstable_cases"), F.coalesce(F.min("runs"), F.lit(0)).alias("repeat"),
    )
    cases_row = rolled.select(F.struct("*").alias("r")).scalar()
    latency_row = _nearest_ranks(results, latency_p50=0.5, latency_p95=0.95).select(F.struct("*").alias("r")).scalar()
    both = rates.withColumns({"case_row": cases_row, "latency_row": latency_row})
    return both.select("*", "case_row.*", "latency_row.*").drop("case_row", "latency_row")


def release_gate(summary: DataFrame, rates: DataFrame, release_mode: bool = True, expected=S.EVAL_CATEGORIES) -> DataFrame:
    """Failure codes and gate decisions for one summary row and its category rates."""
    by_cat = rates.agg(F.map_from_entries(F.collect_list(F.struct("category", "pass_rate"))).alias("m")).select("m").scalar()
    df = summary.withColumn("rates", F.coalesce(by_cat, F.create_map().cast("map<string,double>")))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in expected]), F.map_keys("rates"))) if release_mode else F.array().cast("array<string>")

    def core(c):
        rate = F.element_at("rates", F.lit(c))
        absent = F.when(F.lit(release_mode), F.lit(f"core_missing:{c}"))
        return F.when(rate.isNull(), absent).when(rate < 1.0, F.lit(f"core_below:{c}"))

    codes = [
        F.when(F.col("explicit_cases") > 0, "explicit_violation"), F.when(F.col("critical_cases") > 0, "critical_failure"),
        F.when(F.size("missing") > 0, F.concat(F.lit("missing:"), F.array_join("missing", ","))),
        F.when(F.lit(release_mode) & (F.col("repeat") < S.MIN_RELEASE_REPEAT), "too_few_repeats"),
        F.when(F.col("protocol_rate") < S.GATE_PROTOCOL, "protocol"), F.when(F.col("status_accuracy") < S.GATE_STATUS, "status"),
        F.when(F.col("answerable_valid") < S.GATE_ANSWERABLE, "answerable"), F.when(F.col("not_found_hold") < S.GATE_HOLD, "hold"),
        *[core(c) for c in S.CORE_CATEGORIES],
    ]
    df = df.withColumn("missing", missing).withColumn("failures", F.array_compact(F.array(*codes)))
    complete = (F.size("missing") == 0) & ~F.array_contains("failures", "too_few_repeats")
    quality = F.filter("failures", lambda f: ~f.isin("explicit_violation", "critical_failure"))
    return df.select(
        "failures", (F.col("explicit_cases") == 0).alias("explicit_passed"), (F.col("critical_cases") == 0).alias("critical_passed"),
        complete.alias("coverage_complete"), (F.size(quality) == 0).alias("model_gate_passed"),
    )


def gate_verdict(gates: DataFrame, policy: DataFrame) -> DataFrame:
    """Verdict per model.  `policy`: model, on_pass, on_fail, on_violation (other models are held)."""
    hold = F.lit("release_hold")
    df = gates.join(policy, "model", "left")
    verdict = (
        F.when(~F.col("explicit_passed"), F.coalesce("on_violation", hold))
        .when(~F.col("critical_passed") | ~F.col("coverage_complete"), hold)
        .when(F.col("model_gate_passed"), F.coalesce("on_pass", hold)).otherwise(F.coalesce("on_fail", hold))
    )
    return df.withColumn("verdict", verdict).drop("on_pass", "on_fail", "on_violation")


def eval_report(summary: DataFrame, gate: DataFrame, cases: DataFrame, rates: DataFrame) -> DataFrame:
    """Report rows (section, name, value); no document, question or model text is part of it."""
    def pairs(df, section, columns):
        entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])
        return df.select(F.lit(section).alias("section"), F.explode(entries).alias("e")).select("section", "e.name", "e.value")

    top = pairs(summary, "summary", [c for c in summary.columns if not c.startswith("latency")])
    decision = gate.withColumn("failures", F.array_join("failures", ";"))
    out = top.unionByName(pairs(decision, "gate", decision.columns))
    out = out.unionByName(rates.select(F.lit("category").alias("section"), F.col("category").alias("name"), F.col("pass_rate").cast("decimal(6,4)").cast("string").alias("value")))
    return out.unionByName(cases.select(F.lit("case").alias("section"), F.col("case_id").cast("string").alias("name"),
                                        F.concat_ws("|", "category", F.col("runs").cast("string"), F.col("passes").cast("string"), F.col("final_pass").cast("string")).alias("value")))


def case_reports(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One JSON document per case: its roll-up, and a diagnosis of each of its runs in order.

    Holds classes and numbers only, no text of a document, question or model.  Cases stay rows (JSON lines when written), as there
    may be as many as documents; a case has a few repeats.  A case without runs has an empty list of diagnoses.
    """
    failed = F.filter(F.array(*[F.when(~F.col(f"check_{c}"), F.lit(c)) for c in S.EVAL_CHECKS]), lambda c: c.isNotNull())
    named = {"status": "terminalStatus", "failure_category": "failureCategory", "provider_error": "providerErrorCategory", "claim_count": "claimCount",
             "citation_count": "citationCount", "latency": "latencySec", "explicit": "explicitSafetyViolation", "critical": "criticalCaseFailure"}
    run = F.struct(F.col("run_index").alias("runIndex"), "passed", failed.alias("failedChecks"), *[F.col(c).alias(n) for c, n in named.items()])
    each = results.groupBy("case_id").agg(F.array_sort(F.collect_list(run)).alias("runDiagnostics"))
    rolled = {"case_id": "caseId", "category": "category", "safety_critical": "safetyCritical", "runs": "runs", "passes": "passes", "pass_rate": "passRate",
              "statuses": "statuses", "last_status": "answerStatus", "claim_count": "claimCount", "citation_count": "citationCount", "mean_latency": "latencySec",
              "unstable": "unstable", "safety_failed": "safetyFailed", "explicit": "explicitSafetyViolation", "critical": "criticalCaseFailure",
              "violations": "safetyViolations", "final_pass": "finalPass"}
    df = cases.join(each, "case_id", "left").withColumn("runDiagnostics", F.coalesce("runDiagnostics", F.array().cast(each.schema["runDiagnostics"].dataType)))
    body = F.struct(*[F.col(c).alias(n) for c, n in rolled.items()], "runDiagnostics")
    return df.select("case_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))
