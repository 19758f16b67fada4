"""Hand-written cases for search, answers, summaries, evaluation, sources and streams."""

import datetime
import hashlib
import itertools
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagewright import settings as S
from pagewright.functions import text as T
from pagewright.operators import evaluation as E
from pagewright.operators import lifecycle as Y
from pagewright.operators import qa as Q
from pagewright.operators import search as R
from pagewright.operators import summary as U
from pagewright.sources import corpus as C
from pagewright.sources import files as I
from pagewright.sources.sinks import compact_document_rows, read_document_rows, replace_document_rows
from pagewright.streaming import answers as W
from pagewright.streaming import ingest as N


def test_two_letter_query_is_found_by_the_scan(spark):
    chunks = spark.createDataFrame([(1, "a", 0, "심장 질환", "s", 1, 1), (1, "b", 1, "혈압", None, 1, 1), (2, "c", 0, "심장", "s", 1, 1)],
                                   "document_id long, chunk_id string, chunk_index long, normalized_text string, section_title string, page_start long, page_end long")
    q = spark.createDataFrame([(9, 1, "심장", "keyword", 5)], "query_id long, document_id long, query string, mode string, limit long")
    assert [r.chunk_id for r in R.hybrid_search(q, chunks, None).collect()] == ["a"]


def test_proximity_equals_all_pairs(spark):
    import random

    rnd = random.Random(1)
    rows = []
    for i in range(200):
        s = rnd.randint(1, 2000)
        rows.append((7, f"c{i}", s, s + rnd.choice([0, 0, 0, 1, 5])))
    got = {r.chunk_id: r.bonus for r in R.page_proximity_bonus(spark.createDataFrame(rows, "query_id long, chunk_id string, page_start long, page_end long")).collect()}
    for _, c, s, e in rows:
        others = [(a, b) for _, o, a, b in rows if o != c]
        same = any(s <= b and a <= e for a, b in others)
        touch = any(s - b == 1 or a - e == 1 for a, b in others)
        assert got[c] == (0.05 if same else 0.02 if touch else 0.0)


def judge(spark, claims, context):
    c = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(claims)], "message_id long, claim_no long, text string, source_chunk_ids array<string>")
    x = spark.createDataFrame([(1, i, k, t) for i, (k, t) in enumerate(context)], "message_id long, rank long, chunk_id string, text string")
    return c, x


def test_claim_rules(spark):
    c, x = judge(spark, [("아스피린 50 mg 투여", ["a"]), ("아스피린 50 mg", ["a", "z"]), ("아스피린 투여하지 않는다", ["b"]), ("전혀 다른 내용", ["a"]), ("아스피린", ["z"]), (" ", ["a"])],
                 [("a", "아스피린 150 mg 투여"), ("b", "아스피린 투여하지 한다")])
    got = [r.reason for r in Q.classify_claims(c, x).orderBy("claim_no").collect()]
    assert got == ["number_not_in_source", "number_not_in_source", "not_lexically_grounded", "not_lexically_grounded", "no_valid_source", "empty_text"]


def test_conflict_needs_opposite_polarity_and_shared_subject(spark):
    def conflict(*texts):
        df = spark.createDataFrame([(1, t) for t in texts], "message_id long, claim_text string")
        return Q.claims_conflict(df).first().conflict

    assert conflict("drug alpha lowers pressure", "drug alpha pressure is not lowered lowers")
    assert not conflict("drug alpha lowers pressure", "the cat does not sleep")
    assert not conflict("drug alpha lowers pressure", "drug alpha lowers pressure more")


def test_nodes_are_reused(spark):
    plan = spark.createDataFrame([(1, 0, 0, "k", "h0", "t", "text", 1), (1, 1, 0, "k", "h1", "t", "other", 1)],
                                 "document_id long, position long, level int, context_key string, input_hash string, section_title string, source_text string, n_sources long")
    first = U.reuse_nodes(plan, spark.createDataFrame([], "document_id long, input_hash string, summary string, status string")).cache()
    again = U.reuse_nodes(plan, first.select("document_id", "input_hash", "summary", "status"))
    assert [r.reused for r in first.collect()] == [False, False] and all(r.reused and r.attempts == 0 for r in again.collect())


def test_bad_model_text_fails_the_node(spark):
    plan = spark.createDataFrame([(1, "x")], "position long, source_text string")
    assert U.summarize_groups(plan, lambda t: F.repeat(t, 401)).first().status == "failed"


def test_every_transition(spark):
    rows = []
    for n, (a, b) in enumerate(itertools.product(S.DOCUMENT_STATES, repeat=2)):
        rows += [(n, 1, "2024-01-01 00:00:00", a, True), (n, 2, "2024-01-03 05:00:00", b, b in S.ALLOWED_TRANSITIONS[a])]
    df = spark.createDataFrame(rows, "document_id long, event_id long, t string, new_status string, want boolean").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert all(r.allowed == r.want for r in Y.check_transitions(df).collect())


def test_replayed_maps_equal_single_steps(spark):
    import random

    pick = random.Random(3)
    rows = [(pick.choice([None, 1, 1, 1, 2]), n % 40, "2024-01-01 00:00:07", pick.choice([*S.DOCUMENT_STATES, "other", None])) for n in range(6000)]
    rows += [(9, n, f"2024-01-0{1 + n % 9} 00:00:00", pick.choice(S.DOCUMENT_STATES)) for n in range(50)]
    df = spark.createDataFrame(rows, "document_id long, event_id long, t string, new_status string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    want = {}
    for d, e, t, s in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2], r[1], r[3] is not None, r[3])):
        n, now = want.get(d, (0, "uploaded"))
        want[d] = n + 1, s if s in S.ALLOWED_TRANSITIONS[now] else now
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("7", size):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = {r.document_id: (r.events, r.status) for r in Y.replay_status(df.repartition(5)).collect()}
        assert got == want
    assert Y.replay_status(df.limit(0)).count() == 0


def test_artifacts_over_short_runs(spark, monkeypatch):
    rows = [(1 + n % 2, n, U.KINDS[n * 7 % 5], f"t{n}", f"text {n}") for n in range(200)]
    items = spark.createDataFrame(rows, "document_id long, item_no long, kind string, title string, text string").withColumn("source_type", F.lit("document"))
    plain = sorted(map(str, U.build_artifacts(items, items).collect()))
    monkeypatch.setattr(U, "ITEM_RUN", 3)
    assert sorted(map(str, U.build_artifacts(items, items).collect())) == plain and len(plain) == 200


@pytest.mark.parametrize("seed", range(3))
def test_number_keys_equal_the_pattern(spark, seed):
    import random

    pick = random.Random(seed)
    rows = [("".join(pick.choices("123.,% x", k=pick.randint(0, 14))), "".join(pick.choices("1234.,% ", k=pick.randint(1, 7)))) for _ in range(800)]
    df = spark.createDataFrame(rows, "hay string, claim string").select("hay", F.explode(T.extract_numbers("claim")).alias("n"))
    keys = E._number_keys(F.replace("hay", F.lit(","), F.lit("")))
    both = df.select("hay", "n", F.array_contains(keys, F.replace("n", F.lit(","), F.lit(""))).alias("a"), T.number_in_text("hay", "n", "eval").alias("b")).collect()
    assert any(r.b for r in both) and [r for r in both if r.a != r.b] == []


def test_gate_holds_incomplete_releases(spark):
    good = "total_runs protocol_rate status_accuracy answerable_valid not_found_hold total_cases safety_failure_cases explicit_cases critical_cases unstable_cases repeat".split()
    one = spark.createDataFrame([(9, 1.0, 1.0, 1.0, 1.0, 9, 0, 0, 0, 0, 2)], good)
    rates = spark.createDataFrame([(c, 1.0) for c in S.EVAL_CATEGORIES if c != "unit"], "category string, pass_rate double")
    r = E.release_gate(one, rates).first()
    assert not r.coverage_complete and not r.model_gate_passed and "too_few_repeats" in r.failures and "core_missing:unit" in r.failures
    assert E.release_gate(one, rates, release_mode=False).first().model_gate_passed


def test_file_intake(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "b.pdf").write_bytes(b"")
    (tmp_path / "c.pdf").write_bytes(b"hello")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}.pdf",) for n in "abcd"], "path string")
    got = {r.path[-5]: r.verdict for r in I.file_intake_scan(spark, str(tmp_path), 50, listing).collect()}
    assert got == {"a": "ok", "b": "EMPTY_PDF", "c": "INVALID_FILE_TYPE", "d": "FILE_TOO_LARGE"}


def test_rerun_replaces_rows(spark, tmp_path):
    def rows(*found):
        return spark.createDataFrame(list(found), "document_id long, v string")

    path = str(tmp_path / "t")
    replace_document_rows(rows((1, "a"), (1, "b"), (2, "c"), (3, "d")), path, rows((1, ""), (2, ""), (3, "")).select("document_id"))
    for _ in range(2):  # document 3 has no rows any more
        replace_document_rows(rows((1, "z")), path, rows((1, ""), (3, "")).select("document_id"))
    want = [(1, "z"), (2, "c")]
    assert sorted((r.document_id, r.v) for r in read_document_rows(spark, path).collect()) == want
    compact_document_rows(spark, path, f"{path}2")
    assert sorted((r.document_id, r.v) for r in read_document_rows(spark, f"{path}2").collect()) == want
    assert spark.read.parquet(f"{path}2/rows").count() == 2 and len(list((tmp_path / "t2" / "commits").glob("0*"))) == 1


def test_a_write_that_dies_is_repeated_once(spark, tmp_path, monkeypatch):
    """Death between rows, ledger and commit, at each point; then the repeat, and the clean-up."""
    from pagewright.sources import sinks

    def rows(*found):
        return spark.createDataFrame(list(found), "document_id long, v string")

    def stored():
        return sorted((r.document_id, r.v) for r in read_document_rows(spark, path).collect())

    path = str(tmp_path / "t")
    one, docs = rows((1, "a"), (2, "b")), rows((1, ""), (2, ""), (3, "")).select("document_id")
    with pytest.raises(FileNotFoundError):
        read_document_rows(spark, path)
    broken = docs.select(F.assert_true(F.lit(False)).cast("long").alias("document_id"))
    with pytest.raises(Exception):
        replace_document_rows(one, path, broken)  # rows are there, the ledger isn't
    monkeypatch.setattr(sinks.Files, "create_new", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        replace_document_rows(one, path, docs)  # rows and ledger are there, the commit isn't
    monkeypatch.undo()
    assert sinks.ledger(spark, path) is None
    assert replace_document_rows(one, path, docs) == 1
    assert stored() == [(1, "a"), (2, "b")]
    sinks.Files(spark, path).fs.create(sinks.Files(spark, path).of(f"{path}/commits/{2:020d}")).close()  # a writer died in its commit
    assert replace_document_rows(rows((2, "c")), path, rows((2, "")).select("document_id")) == 3
    assert stored() == [(1, "a"), (2, "c")]
    assert sinks.remove_unreferenced(spark, path) == []
    assert sorted(x.split("/")[0] for x in sinks.remove_unreferenced(spark, path, 0) if x.startswith("rows")) == ["rows", "rows"]
    assert stored() == [(1, "a"), (2, "c")]
    assert len(list((tmp_path / "t" / "rows").glob("write_attempt=*"))) == 2


def test_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits while this one writes: other documents are fine, the same document is a conflict."""
    from pagewright.sources import sinks

    def rows(*found):
        return spark.createDataFrame(list(found), "document_id long, v string")

    path, real = str(tmp_path / "t"), sinks.Files.create_new
    replace_document_rows(rows((1, "a"), (2, "b")), path, rows((1, ""), (2, "")).select("document_id"))

    def while_writing(document):
        def create(self, *a):
            monkeypatch.setattr(sinks.Files, "create_new", real)
            replace_document_rows(rows((document, "other")), path, rows((document, "")).select("document_id"))
            return real(self, *a)

        monkeypatch.setattr(sinks.Files, "create_new", create)

    while_writing(2)
    assert replace_document_rows(rows((1, "mine")), path, rows((1, "")).select("document_id")) == 3
    while_writing(1)
    with pytest.raises(sinks.WriteConflict):
        replace_document_rows(rows((1, "again")), path, rows((1, "")).select("document_id"))
    assert sorted((r.document_id, r.v) for r in read_document_rows(spark, path).collect()) == [(1, "other"), (2, "other")]


def test_ingest_newest_revision_and_blank_documents(spark, tmp_path):
    def batch(*docs):
        N.ingest_batch(spark.createDataFrame(list(docs), "document_id long, text string, content_revision long"), path)
        return sorted((r.document_id, r.chunk_revision, r.normalized_text) for r in read_document_rows(spark, path).collect())

    path = str(tmp_path / "t")
    first = batch((1, "old text of one", 1), (1, "new text of one", 2), (2, "text of two", 1))
    assert first == [(1, 2, "new text of one"), (2, 1, "text of two")]
    assert batch((1, "late old text", 1), (2, "text of two again", 1)) == first
    assert batch((1, " ", 3)) == first[1:]
    assert batch((1, "text after that is stale", 2)) == first[1:]


def test_texts_are_looked_at_once(spark):
    df = spark.createDataFrame([("It is  NOT so",), ("plain",), (None,), ("no",)], "text string")
    found = df.select(T.negation_markers("text", (" not ", " no ", "n't")).alias("m"))
    # white space is collapsed once for all markers
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
    assert [r.m for r in found.collect()] == [[" not "], [], [], [" no "]]
    answers = spark.createDataFrame([(1, "a", "answered", ["f"])], "message_id long, answer string, answer_status string, follow_ups array<string>")
    claims = spark.createDataFrame([(1, 1, "the red big pump runs", ["c"]), (1, 2, "the red big pump no runs", ["c"])], "message_id long, claim_no long, text string, source_chunk_ids array<string>")
    context = spark.createDataFrame([(1, 0, "c", "the red big pump runs or no runs")], "message_id long, rank long, chunk_id string, text string")
    result = Q.verify_answers(answers, claims, context)[0]
    assert len([ln for ln in result._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in ln and "raw_no" in ln]) == 1
    row = result.first()
    assert (row.status, row.n_claims, row.n_supported) == ("conflicting_evidence", 2, 2)


def test_ingest_reads_a_table_of_part_files(spark, tmp_path):
    rows = [(i, f"line one of {i}\nand a second one", "en", "web", 30) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "parts" / "other.parquet"))
    out = str(tmp_path / "chunks")
    N.incremental_ingest(spark, str(tmp_path / "parts"), out, str(tmp_path / "state"), "documents.parquet").awaitTermination()
    assert {r.document_id for r in read_document_rows(spark, out).collect()} == set(range(6))
    # a folder of single files, as before
    flat = str(tmp_path / "parts" / "other.parquet")
    N.incremental_ingest(spark, flat, out + "2", str(tmp_path / "state2")).awaitTermination()
    assert {r.document_id for r in read_document_rows(spark, out + "2").collect()} == set(range(6))


def test_a_killed_ingestion_goes_on(spark, tmp_path, monkeypatch):
    """Death in each step, one after the other: what was committed stays, the next run does the rest, and nothing is there twice."""
    from pagewright.operators import index as I_
    from pagewright.sources import sinks

    out, steps = str(tmp_path / "chunks"), list(N.STEPS)

    def recognise(docs, sheet):
        return C.words_of(C.blocks_of(docs)).drop("source_method").filter("document_id = 7")

    def docs(*rows):
        return spark.createDataFrame(list(rows), "document_id long, text string, content_revision long")

    def commits():
        return [len(sinks.commits(spark, N.place(out, s))) for s in steps]

    N.ingest_batch(docs((7, "a line of seven\nand one more", 1), (8, "eight has a line", 1), (9, " ", 1)), out, recognise, True)
    assert commits() == [1] * 5
    N.validate(docs((7, "seven is new now", 2), (10, None, 1)), out)
    for n, (module, name) in enumerate([(N, "_extract"), (N, "_ocr"), (N, "_chunk"), (N.I, "write_index")]):
        with monkeypatch.context() as m, pytest.raises(ZeroDivisionError):
            m.setattr(module, name, lambda *a: 1 / 0)
            N.advance(spark, out, recognise, True)
        assert commits() == [2] * (n + 1) + [1] * (4 - n)
    assert N.advance(spark, out, recognise, True) == ["index"]
    assert N.advance(spark, out, recognise, True) == [] and commits() == [2] * 5
    chunks = sorted((r.document_id, r.chunk_revision, r.normalized_text) for r in read_document_rows(spark, out).collect())
    assert chunks == [(7, 2, "seven is new now"), (8, 1, "eight has a line")]
    words = sorted((r.document_id, r.word) for r in I_.read_index(spark, f"{out}/index").postings.collect())
    assert words == [(7, "is"), (7, "new"), (7, "now"), (7, "seven"), (8, "a"), (8, "eight"), (8, "has"), (8, "line")]
    verdicts = {r.document_id: r.verdict for r in sinks.ledger(spark, N.place(out, "validate")).collect()}
    assert verdicts == {7: "ok", 8: "ok", 9: "EMPTY", 10: "EMPTY"}


def test_streamed_model_output(spark):
    def frame(text):
        return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})

    lines = [": hello", frame('{"type":"claim","te'), "", "{broken", frame('xt":"real"}\n{"type":"no'), frame('te"}\nnot json\n'), frame('{"type":"final","answerStatus":"answered"}'),
             "data: [DONE]", frame('\n{"type":"claim","text":"late"}\n')]
    many = [frame('{"type":"claim","text":"%d"}\n' % i) for i in range(25)] + [frame('{"type":"final"}\n')]
    ended = [frame('{"type":"final"}\n{"type":"claim","text":"after"}\n')]
    rows = [(k, i, v) for k, x in (("a", lines), ("b", many), ("c", ended), ("d", ["data: [DONE]"])) for i, v in enumerate(x)]
    got = {}
    for r in sorted(I.parse_model_stream(spark.createDataFrame(rows, "file string, line_no long, value string")).collect(), key=lambda r: (r.file, r.seq)):
        got.setdefault(r.file, []).append((r.type, r.text))
    assert got == {"a": [("claim", "real"), ("final", None)], "b": [("claim", str(i)) for i in range(20)], "c": [("final", None)]}


def test_chunk_set_hash_is_one_hash(spark):
    """Long sets, gaps in the numbers, ids of unequal length, equal ids."""
    sets = {1: [("c1", "x"), ("c10", "y"), ("c1", "a")], 2: [(f"{i:05d}", f"h{i}") for i in range(9000)], 3: [(str(i), "h") for i in (0, 5000)]}
    rows = [(d, i, c, h) for d, x in sets.items() for i, (c, h) in enumerate(x)]
    df = spark.createDataFrame(rows, "document_id long, chunk_index long, chunk_id string, content_hash string").repartition(7)
    got = {r.document_id: (r.set_hash, r.n_chunks) for r in Q.chunk_set_hash(df).collect()}
    assert got == {d: (hashlib.sha256("\n".join(f"{c}:{h}" for c, h in sorted(x)).encode()).hexdigest(), len(x)) for d, x in sets.items()}


def test_rates_round_half_to_even(spark):
    rows = [(i, "x", "a" if i else "b", False) for i in range(32)]
    df = spark.createDataFrame(rows, "case_id long, category string, name string, final_pass boolean").withColumn("final_pass", F.col("case_id") == 0)
    assert E.category_rates(df).first().pass_rate == 0.0312


def test_short_shards_change_nothing(spark, monkeypatch):
    """Groups with shards of three chunks are those with whole documents in a shard, also after a join on the same columns."""
    chunks = C.v_chunks(spark, "/root/testdata/sf0.001").select("document_id", "chunk_index", "normalized_text", "section_title")

    def made():
        return sorted(U.group_chunks(chunks, 900, 600).select("document_id", "chunk_index", "position").collect())

    whole = made()
    monkeypatch.setattr(S, "DRAFTS_PER_SHARD", 3)
    assert made() == whole


def test_stream_equals_batch(spark, tmp_path):
    events = [(m, s, "claim", f"alpha beta {m} {s}" if s % 3 else "nothing shared", ["k"]) for m in range(8) for s in range(1, 7)] + [(m, 50, "final", None, None) for m in range(0, 8, 2)]
    df = spark.createDataFrame(events, "message_id long, event_seq long, type string, text string, source_chunk_ids array<string>")
    df = df.withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_seq"))).withColumn("answer_status", F.lit("answered"))
    context = spark.createDataFrame([(m, 0, "k", f"alpha beta {m} 1 2 4 5") for m in range(8)], "message_id long, rank long, chunk_id string, text string")
    df.drop("answer_status").write.parquet(str(tmp_path / "in"))
    live = W.stream_answers(spark.readStream.schema(df.drop("answer_status").schema).parquet(str(tmp_path / "in")), context)
    live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    shown = W.stream_claims(df.withColumnRenamed("event_seq", "seq"), context)[0].collect()
    assert {(r.message_id, r.seq, r.text) for r in out if r.kind == "claim"} == {(r.message_id, r.seq, r.claim_text) for r in shown}
    ended = [r.message_id for r in out if r.kind == "terminal"]
    assert len(ended) == len(set(ended)) and set(range(0, 8, 2)) <= set(ended)


def _live(spark, tmp_path, events, changes, context, files=1):
    """Terminal rows and shown claims of a stream over so many files, one after the other."""
    ev = "message_id long, event_seq long, t long, type string, text string, source_chunk_ids array<string>, answer_status string"
    for name, rows, ddl in (("events", events, ev), ("changes", changes, "message_id long, change_seq long, t long, status string")):
        rows = sorted(rows, key=lambda r: r[1])
        for k in range(files):
            part = spark.createDataFrame(rows[k * len(rows) // files:(k + 1) * len(rows) // files], ddl).withColumn("event_time", F.timestamp_seconds("t")).drop("t")
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n in ("events", "changes")]
    with W.list_state(spark):
        W.live_answers(*streams, spark.createDataFrame(context, "message_id long, rank long, chunk_id string, text string")).writeStream.format("parquet").option(
            "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    return {r.message_id: (r.status, r.text) for r in out if r.kind == "terminal"}, sorted((r.message_id, r.seq, r.claim_index, r.text) for r in out if r.kind == "claim")


def test_live_answers_end_in_real_statuses(spark, tmp_path):
    def claim(m, s, text="alpha beta gamma delta", t=0):
        return (m, s, 1000 + t, "claim", text, ["k"], None)

    def end(m, s, kind="final", hint="answered", t=0):
        return (m, s, 1000 + t, kind, None, None, hint)

    context = [(m, 0, "k", "alpha beta gamma delta not alpha beta gamma delta 않다") for m in range(20) if m != 3]
    events = [claim(1, 1), claim(1, 2, "nothing shared"), claim(1, 3, "alpha beta"), end(1, 9), end(1, 10, "cancel"),
              claim(2, 1, "nothing"), end(2, 9), end(3, 9, "done", None),
              claim(4, 1), claim(4, 2, "alpha beta gamma delta 않다"), end(4, 9),
              claim(5, 1), claim(5, 2, "alpha gamma"), end(5, 9, hint="conflicting_evidence"),
              *[claim(6, s) for s in range(1, 30)], end(6, 50, hint="conflicting_evidence"),
              *[claim(7, s) for s in range(1, 8)], end(7, 9), *[claim(8, s) for s in range(1, 8)], end(8, 9),
              claim(9, 1), end(9, 2, "cancel"), claim(10, 1), end(10, 2, "lost"), claim(11, 1), claim(11, 2, t=31), end(11, 3, t=31),
              *[claim(12, s, t=29 * s) for s in range(1, 9)], claim(13, 1), end(13, 9)]
    changes = [(7, 4, 1000, "consent_revoked"), (8, 6, 1000, "revision_changed"), (8, 6, 1000, "consent_revoked"), (13, 8, 1000, "revision_changed"), (1, 60, 1000, "revision_changed")]
    got, shown = _live(spark, tmp_path, events, changes, context)
    assert {m: s for m, (s, _) in got.items()} == {
        1: "completed", 2: "insufficient_evidence", 3: "not_found", 4: "conflicting_evidence", 5: "conflicting_evidence", 6: "completed", 7: "consent_revoked",
        8: "revision_changed", 9: "cancelled", 10: "interrupted", 11: "failed", 12: "failed", 13: "revision_changed"}
    assert got[1][1] == "alpha beta gamma delta\nalpha beta" and got[2][1] == S.INSUFFICIENT_TEXT and got[3][1] == S.NOT_FOUND_TEXT and got[7][1] == S.CONSENT_REVOKED_TEXT
    counts = {m: sum(1 for x in shown if x[0] == m) for m in got}
    assert counts == {1: 2, 2: 0, 3: 0, 4: 2, 5: 2, 6: 20, 7: 5, 8: 5, 9: 1, 10: 1, 11: 1, 12: 7, 13: 1}
    assert [x[1:3] for x in shown if x[0] == 6] == [(i + 1, i) for i in range(20)]


def test_a_new_live_answer_takes_one_look_at_the_state():
    """Each look is a round trip; an answer that begins and ends in one batch has nothing stored to read or to clear."""
    calls = []

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, call):
            return lambda *args: calls.append(f"{self.name}.{call}")

    class Handle:
        getValueState = getListState = lambda self, name, schema: State(name)

    state = W.AnswerState()
    state.init(Handle())
    event = Row("message_id", "event_seq", "event_time", "type", "answer_status", "claim_text", "reason", "had_context", "negated", "subject")
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [event(1, 3, at, "final", "answered", None, None, True, None, None), event(1, 2, at, "claim", None, None, "empty_text", True, None, None),
            event(1, 1, at, "claim", None, "a b", None, True, False, ["a", "b"])]
    out = [r.asDict() for r in state.handleInputRows((1,), iter(rows), None)]
    assert [(r["kind"], r["seq"], r["text"], r["status"]) for r in out] == [("claim", 1, "a b", None), ("terminal", 1, "a b", "completed")]
    assert calls == ["progress.get", "progress.update"]


def test_live_answers_over_many_batches_and_silence(spark, tmp_path):
    """State lives on between micro-batches; an answer that falls silent fails once, by its timer."""
    events = [(m, s, 1000 + s, "claim", f"alpha {s}", ["k"], None) for m in (1, 2) for s in range(1, 7)] + [(1, 7, 1007, "final", None, None, "answered")]
    events += [(9, 100 + k, 1000 + 3000 * k, "claim", "alpha", ["k"], None) for k in range(4)]  # another answer moves the watermark on
    got, shown = _live(spark, tmp_path, events, [(7, 1, 1000, "revision_changed")] * 4, [(m, 0, "k", "alpha 1 2 3 4 5 6") for m in (1, 2, 9)], 4)
    assert got[1] == ("completed", "\n".join(f"alpha {s}" for s in range(1, 7))) and got[2] == ("failed", S.STREAM_FAILED_TEXT) and got[9][0] == "failed"
    assert [x[1] for x in shown if x[0] == 2] == list(range(1, 7)) and len(shown) == 13


def test_consent_is_looked_at_after_the_revision(spark):
    claims = spark.createDataFrame([(m, r, 10 * r) for m in (1, 2, 3) for r in range(1, 10)], "message_id long, claim_rank long, seq long")
    changes = spark.createDataFrame([(1, 25, "consent_revoked"), (2, 55, "consent_revoked"), (2, 58, "revision_changed"), (3, 95, "consent_revoked")], "message_id long, change_seq long, status string")
    assert sorted(map(tuple, W.periodic_recheck(claims, changes).collect())) == [(1, 3, "consent_revoked"), (2, 6, "revision_changed")]


def test_the_layout_is_computed_once(spark):
    """Plans of chunks read what the folds have written; the documents are scanned by no plan behind a fold."""
    from pagewright.plans.all_queries import QUERIES

    for name, most in (("pack_chunks", 3), ("build_chunks", 4)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("documents.parquet") <= 1 and plan.count("FileScan") <= most, plan
