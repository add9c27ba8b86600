import hashlib
import random
import re

from pyspark.sql import functions as F

from shelfspark.llm.pii import digest_pii, find_pii, luhn, mask_pii, mod97
from tests.llm.helpers import documents

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
PARTS = ["1", "2", "4111111111111111", "378282246310005", ".", " ", "-", "@", "a", "b.c", "x_y", "+", "(", ")", "é", "🙂", "255", "256", "1.2.3.4",
         "+1 (269) 555-3296", "\n", "a@b.com", "%", "0007", "GB82WEST12345698765432", "ssn 123-45-6789", "12-34 56"]


def passes(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def base(text):
    out = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            v, n = m.group(), sum(c.isdigit() for c in m.group())
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= n <= 19 and passes(v), "phone": 10 <= n <= 15}[name]
            if ok:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randrange(30)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "1" * 100_000), (9004, "1 " * 50_000), (9006, "+1" + "(" * 50_000), (9007, "a@b.c " * 5_000), (1, "x@y.z"), (None, "x@y.z")]
    got = digest_pii(find_pii(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    texts = dict(rows)
    for r in got:
        if r.doc_id not in (1, None):
            spans = r.spans.split(",") if r.spans else []
            assert set(base(texts[r.doc_id])) <= set(spans)
            assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    assert digest_pii(find_pii(documents(spark, rows).limit(0))).count() == 0


def test_endless_runs_end(spark):
    rows = [(1, "a" * 300_000), (2, "a." * 100_000 + "@")]
    assert {r.spans for r in digest_pii(find_pii(documents(spark, rows))).collect()} == {""}


def test_added_kinds_and_context(spark):
    rows = [(1, "iban GB82WEST12345698765432."), (2, "GB82WEST12345698765433"), (3, "social security 123-45-6789"), (4, "part 123-45-6789"),
            (5, "+1 (269) 555-3296 4111111111111111")]
    got = {r.doc_id: r.spans for r in digest_pii(find_pii(documents(spark, rows))).collect()}
    assert got[1] == "iban:5:27" and got[2] == "" and got[3] == "ssn:16:27" and got[4] == ""
    assert got[5] == "phone_run:0:17,card_run:18:34"


def test_checksums(spark):
    row = spark.createDataFrame([("4111 1111 1111 1111", "4111111111111112", "DE89370400440532013000", "DE88370400440532013000")], "a string, b string, c string, d string")
    assert tuple(row.select(luhn(F.col("a")), luhn(F.col("b")), mod97(F.col("c")), mod97(F.col("d"))).first()) == (True, False, True, False)


def test_mask(spark):
    rows = [(1, "call +1 (269) 555-3296 or a.b@c.de, 10.0.0.1; 4111111111111111 é"), (2, None), (3, ""), (4, "nothing 12 34")]
    got = {r.doc_id: r.m for r in documents(spark, rows).select("doc_id", mask_pii(F.col("text")).alias("m")).collect()}
    assert got == {1: "call [PHONE] or [EMAIL], [IP]; [CARD] é", 2: None, 3: "", 4: "nothing 12 34"}


def test_no_python_in_the_plan(spark):
    plan = digest_pii(find_pii(documents(spark, [(1, "a@b.c")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
