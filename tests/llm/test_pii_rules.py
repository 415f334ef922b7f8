import collections
import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

from surfaceworks.llm import pii, rules

KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


HARD = [
    "a@b.c_d@e.f.g +1 (22) 333-4444. 1.2.3.4.5.6.7.8 001.2.3.4 256.1.1.1 4111 1111-1111 1111 41111111111111115 x@y.z-.k @a.b a@b +12345678901 ",
    "ñ𝒳 4111-1111-1111-1111 4111  1111 1111 1111 +1", "0 1-2 " * 500, "a" * 5000 + "@", "1 " * 2000 + "+1" * 500, "x@y.zw@v.u", "12 3456 7890 1234 5678 90", "..@-.-", "9" * 14 + " " + "0" * 16,
]


def test_base_spans_are_those_of_the_plain_patterns(spark, odd, empty):
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string"))
    digest = pii.digest(pii.find(df.withColumn("row", F.monotonically_increasing_id()), "row")).collect()
    texts = {r.row: r.text or "" for r in df.withColumn("row", F.monotonically_increasing_id()).collect()}
    assert len(digest) == len(texts)
    for r in digest:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in want).encode()).hexdigest(), texts[r.doc_id][:80]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
    assert pii.find(empty).count() == 0


def test_the_method_adds_what_checksums_or_words_confirm(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32.", "GB82 WEST 1234 5698 7654 33", "my social security number is 078-05-1120", "part no 078-05-1120", "call 555-123-4567 now", "name [at] host [dot] com"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(df).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["ssn"], 3: [], 4: ["national_phone"], 5: ["spelled_email"]}
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "IBAN <iban>." and clean[3] == texts[3]


def test_secrets_and_what_speaks_against_a_span(spark):
    made = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'token = "{made}" then', "password: correcthorsebattery", f"api_key='{made}' # example", "AKIA" + "A1B2" * 4, "-----BEGIN RSA PRIVATE KEY-----", "our token = the thing", "serial 555-123-4567 phone", "version 1.2.3.4 of it"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, round(s.score, 2)) for s in r.spans] for r in pii.find(df).collect()}
    assert got[0] == [("secret", 0.6)] and got[1] == [] and got[2] == [] and got[3] == [("known_key", 0.8)] and got[4][0][0] == "private_key" and got[5] == got[6] == []
    assert got[7] == [("ip", 0.25)]  # base kinds stay whatever their score
    assert {r.doc_id: r.n_spans for r in pii.digest(pii.find(df)).collect()} == {0: 1, 1: 0, 2: 0, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1}


def test_long_texts_full_of_spans_and_none(spark):
    one = "10.0.0.1 a@b.cd "
    df = spark.createDataFrame([(0, one * 20_000), (1, None), (2, "")], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r for r in pii.digest(pii.find(df)).collect()}
    assert found[0].n_spans == 40_000 and found[0].spans.endswith(f"email:{len(one) * 19_999 + 9}:{len(one) * 20_000 - 1}") and found[1].n_spans == found[2].n_spans == 0
    assert time.time() - began < 60
    short = spark.createDataFrame([(0, one * 300), (1, None), (2, ""), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(short).collect()} == {0: "<ip> <email> " * 300, 1: "", 2: "", 3: ""}


def stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if c[tuple(w[i : i + 3])] > 1}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, odd, empty):
    hard = ["a b c d a b c e a b", "x\n\nx\n x\ny\x0bz", "#|<>\n#|<>", " ".join(f"w{i % 40} v{i % 7}" for i in range(600)), "\x1f \x85 q"]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string"))
    got = sorted(tuple(r) for r in rules.statistics(df).select(*rules.STATS).collect())
    assert got == sorted(stats(r.text or "") for r in df.collect())
    assert rules.statistics(empty).count() == 0


def test_learned_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(rules.FEATURES)))
    bad = (x[:, 0] > 0.7) | ((x[:, 2] > 0.8) & (x[:, 4] < 0.3))
    learned = rules.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in learned:
        hit |= rules.covers(r, x)
    assert (hit == bad).mean() > 0.95 and rules.learn(x, np.zeros(600, bool)) == []
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], list(rules.FEATURES)).select(rules.verdict(learned).alias("v"))
    assert [r.v is not None for r in df.collect()] == hit[:50].tolist()


def test_kept(spark):
    df = spark.createDataFrame([(0, "word " * 60), (1, "few words"), (2, " ".join(f"w{i}" for i in range(60))), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.apply(df, []).collect()}
    assert got == {0: (True, False), 1: (True, False), 2: (False, True), 3: (True, False)}
