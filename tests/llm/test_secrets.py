"""Base spans against Python's regular expressions, entropy against counting each window, and redaction."""

import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagewright.llm import secrets

ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PARTS = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "ſecret", '"', "'", " ", "  ", ":", "=", "abcdefgh", "abc", "A1b2C3d4", "AKIA", "AKIA1234567890ABCD", "AKIAAKIA1234",
         "deadbeef", "0123456789abcdef" * 2, "日本", "😀", "\n", ".", "e3b0c44298fc1c149afbf4c8996fb924"]


def _base(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def _joined(found):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in found)


def test_base_spans(spark):
    pick = random.Random(11)
    rows = [(i, "".join(pick.choices(PARTS, k=pick.randint(0, 14)))) for i in range(1500)]
    rows += [(None, None), (5000, ""), (5001, "x" * 300_000 + "token=" + "a" * 50_000), (5002, "token=api_key:abcdefghij"), (5003, "a b" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = secrets.digest(docs).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = _base(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in want) for n in range(3)]
        assert r.base_sha256 == hashlib.sha256(_joined(want).encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, _joined(want).split(","))) <= set(r.spans.split(","))


def _entropy(s, w):
    w = min(w, len(s))
    return max(math.log2(w) - sum(c * math.log2(c) for c in Counter(s[i : i + w]).values()) / w for i in range(len(s) - w + 1))


def test_entropy(spark):
    pick = random.Random(2)
    words = ["".join(pick.choices(pick.choice(["ab", "abcdefghij0123456789", "A"]), k=pick.randint(1, 60))) for _ in range(200)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.highest_entropy(F.col("w"), 20).alias("e"), secrets.highest_entropy(F.lit(""), 20).alias("z"))
    for r in rows.collect():
        assert abs(r.e - _entropy(r.w, 20)) < 1e-9 and r.z == 0


def test_names_and_paths_do_not_hide_secrets(spark):
    blob, slashed = "q9Zt4LwX7bVn2RkP0sHd5MfJ8cYa", "wJbkrXUtnFQMI/K7MDENG/bPxRfiCYzTq2VwLKeY"
    hidden = [f"AWS_SECRET_ACCESS_KEY={blob}", f"AWS_SECRET_ACCESS_KEY={slashed}", f"host/services/incoming/webhooks/{blob}", f"EXAMPLE_KEY={blob}", f"samples/{blob}", f"your_name={blob}==",
              f"live_signing_secret_{blob}", f"a/b/example/services/incoming/webhooks/T00/{blob}", f"one_two_three_four={blob}=five"]
    known = [f"EXAMPLE{blob}", f"KEY=EXAMPLE{blob}", f"AWS_SECRET_ACCESS_KEY=your_{blob}", "some_long_name_of_many_words_Number_1_and_more_words", "Services/incoming/webhooks/of/the/year/2024/and/more",
             "SECRET_ACCESS_KEY_NAME=" + "aB1" * 12, "some_name_of_words=" + "x" * 40 + "A1"]
    rows = [(i, f"see {x} there") for i, x in enumerate(hidden + known)] + [(900, "k" * 20_000 + "=b1C_" + "abc_def_ghi_" * 5_000), (901, "ab_Cd1" * 10_000 + "sample/")]
    found = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, x in enumerate(hidden + known):
        assert found[i] == (f"entropy:4:{4 + len(x)}" if i < len(hidden) else ""), x
    assert found[900] == found[901] == ""


def test_classes_of_one_case(spark):
    keys = ["0A1B9C8D7E6F5A4B3C2D1E0F" * 2, "JBSWY3DPEHPK3PXPQ7LM2ZT5K4RA", "q9zt4lwx7bvn2rkp0shd5mfj8cya", "0a1b9c8d7e6f5a4b3c2d1e0f"]
    rows, want = [], []
    for key in keys:
        for before in ("", "AES_KEY=", "key-", "k_", "host/path/", "é "):
            rows.append((len(rows), before + key + " ."))
            want.append((len(before), len(before) + len(key)))
    rows += [(800, "A" * 30 + "1"), (801, "thhendanaathehathereistheon1"), (802, "THHENDANAATHEHATHEREISTHEON"), (803, "Key_Ab1=0A1B9C8D7E6F5A4B3C2D1E0F")]
    found = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (a, b) in enumerate(want):
        # in a candidate of all classes of characters, the place may be found with its name
        assert found[i] in (f"entropy:{a}:{b}", f"entropy:0:{b}"), rows[i]
    assert found[800] == found[801] == found[802] == "" and len(found[803].split(",")) == 1


def test_entropy_spans_allow_list_and_redaction(spark):
    blob = "q9Zt4LwX7bVn2RkP0sHd5MfJ8cYa"
    rows = [(1, f"é key {blob} end", "c"), (2, f"key EXAMPLE{blob}", "c"), (3, "thhendanaathehathereistheon " * 5, "c"), (4, f'token = "{blob}" and AKIA1234567890ABCD.', "c"),
            (5, "abc/def/ghi/Jkl1" * 3, "c"), (6, None, "c"), (6, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, secrets string")
    found = {r.doc_id: r.spans for r in secrets.digest(docs).collect()}
    assert found[1] == f"entropy:6:{6 + len(blob)}" and found[2] == found[3] == found[5] == found[6] == ""
    assert found[4] == f"assign:0:{9 + len(blob)},access:{15 + len(blob)}:{33 + len(blob)}"
    scanned = secrets.scan(docs)
    assert scanned.columns == ["doc_id", "text", "secrets_base", "secrets"]
    out = {r.doc_id: r.t for r in scanned.select("doc_id", secrets.redacted(F.col("text"), F.col("secrets")).alias("t")).collect()}
    assert out[1] == "é key [secret] end" and out[4] == '[secret]" and [secret].' and out[3] == rows[2][1] and out[6] is None
    assert secrets.digest(docs.limit(0)).count() == 0
    plan = secrets.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
