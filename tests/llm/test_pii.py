from __future__ import annotations

import hashlib
import random
import re
import time

from finlens.llm import pii as P
from finlens.llm import queries as Q
from tests.llm.helpers import DOCS, EDGE_TEXTS, by_id, documents, with_clashes

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), number, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def with_check_digit(body):
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def iban(country, body):
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02d}{body}"


def snippets(seed, count):
    """Texts of glued pieces, many near misses among them."""
    rnd = random.Random(seed)
    card = with_check_digit("453957876362148")
    pieces = ["a.b+c@mail.example.com", "x@y", "@a.b", "a@b.c.d.", "a@b@c.d", "q%a@b.c%x@d.e", "10.0.0.255", "10.0.0.256", "0010.1.2.03",
              "1.2.3.4.5.6.7.8", "1.2.3", card, " ".join(card[i:i + 4] for i in range(0, 16, 4)), card[:-1] + "0", "4-5-3",
              "1" * 30, "+1 (555) 010-9999", "+4912", "+ 1", "+1 ", "+12345678901234567890", "++49 30 1234567", "é", "ü€", " ", "\n", "-", ".",
              "phone", "version", "😀", "0", "x", iban("DE", "370400440532013000")]
    return ["".join(rnd.choice(pieces) + rnd.choice(["", " ", "", ", "]) for _ in range(rnd.randint(1, 40))) for _ in range(count)]


def test_base_spans_equal_brute_force(spark):
    texts = [*EDGE_TEXTS, *snippets(3, 400)]
    got = by_id(P.find_spans(with_clashes(documents(spark, texts)).repartition(3)))
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i].spans if s.base] == base_spans(t), t


def test_checksums_and_context(spark):
    good = iban("DE", "370400440532013000")
    spaced = " ".join(good[i:i + 4] for i in range(0, len(good), 4))
    texts = [f"x {good}, y", f"bank account {spaced} THE end", good.replace("5", "6", 1), f"A{good}", "ssn: 219-09-9999", "219-09-9999",
             "ssn 000-12-3456", "born 1990-02-28.", "on 1990-02-28.", "release 10.1.2.3", "server 10.1.2.3", f"é{iban('NO', '86011117947')}",
             "invoice for ssn 219-09-9999"]
    got = by_id(P.find_spans(documents(spark, texts)))
    found = [[(s.kind, texts[i][s.start:s.end], s.score) for s in got[i].spans] for i in range(len(texts))]
    assert found[0] == [("iban", good, 80)] and found[1] == [("iban", spaced, 100)]
    assert found[2] == [] and found[3] == [] and found[5] == [] and found[6] == [] and found[8] == [] and found[12] == []
    assert found[4] == [("ssn", "219-09-9999", 60)] and found[7] == [("birth", "1990-02-28", 60)]
    assert found[9] == [("ip", "10.1.2.3", 30)] and found[10] == [("ip", "10.1.2.3", 90)]
    assert found[11] == [("iban", iban("NO", "86011117947"), 80)]


def test_long_texts_cost_their_length(spark):
    """Runs that a pattern could rescan, one very long match, many matches."""
    many = "call +1 555 010 9999 or a@b.cc " * 20_000
    texts = ["x" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "a@" + "b." * 500_000 + "c", "a@b" * 300_000, "+" * 1_000_000, many]
    began = time.time()
    got = by_id(P.find_spans(documents(spark, texts)))
    assert time.time() - began < 120
    assert [(s.kind, s.start, s.end) for s in got[3].spans] == [("email", 0, len(texts[3]))]
    assert len(got[6].spans) == 40_000 and [s.start for s in got[6].spans][-2:] == [len(many) - 26, len(many) - 7]
    assert all(got[i].spans == [] for i in (0, 1, 5))


def test_query_equals_brute_force(spark, tmp_path):
    texts = [*EDGE_TEXTS, *snippets(8, 60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "a@b.cc", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(Q.op13_pii(spark, str(tmp_path)))
    for d, t, *_ in rows:
        base = base_spans(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[d].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in BASE] == [sum(x == k for x, _, _ in base) for k in BASE]
        assert [x for x in got[d].spans.split(",") if x and x.split(":")[0] in BASE] == [x for x in joined.split(",") if x]


def test_no_python_in_the_plan_and_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.op13_pii(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert out.collect() == []
