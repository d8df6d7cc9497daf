import random
import re

from kinweave.llm import pii


def brute(text):
    """The four patterns as they are written, by the regex engine alone."""
    out = {k: [] for k in pii.BASE}
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(digits(m[0])) <= 15:
            out["phone"].append(m.span())
    return out


def test_base_spans_are_those_of_the_patterns():
    random.seed(3)
    bits = ["a", "b.c", "@", "@@", ".", "x@y.zz", " ", "-", "+", "+1", "12", "1.2.3.4", "255", "0256", "4111 1111 1111 1111", "4111-1111", "(0)", "é", "\n", "_%", "192.168.0.1", "5500005555555559"]
    for _ in range(20000):
        t = "".join(random.choices(bits, k=random.randint(0, 14)))
        assert pii.base_spans(t) == brute(t), t


def test_added_spans():
    spans = lambda t: pii.find(t)[5]
    assert spans("pay to DE89 3704 0044 0532 0130 00 now") == "iban:7:34"
    assert spans("pay to DE88 3704 0044 0532 0130 00 now") == ""
    assert spans("my ssn is 123-45-6789.") == "ssn:10:21"
    assert spans("part 123-45-6789.") == ""
    assert spans("card 378282246310005 amex") == "card:5:20"
    assert spans("phone 555 123 4567") == "phone:6:18"
    assert spans(None) == spans("") == spans("plain words, no data 12 34") == ""


def test_long_texts_are_linear():
    assert pii.find("a" * 300_000 + "1" * 300_000 + "+" * 100_000)[:4] == (0, 0, 0, 0)


def test_table(spark):
    df = spark.createDataFrame([(1, "a@b.cc", "x"), (1, "a@b.cc", "y"), (None, None, None), (3, "", "n")], "doc_id bigint, text string, spans string")
    rows = sorted(map(tuple, pii.pii(df).collect()), key=str)
    assert len(rows) == 4 and [r[1] for r in rows].count(1) == 2
    assert pii.pii(df.limit(0)).collect() == []
    assert {r.masked for r in pii.masked(df).collect()} == {"<email>", None, ""}


def test_ibans_before_other_words():
    spans = lambda t: pii.find(t)[5]
    assert spans("ES9121000418450200051332 EUR") == "iban:0:24"
    assert spans("to BE68 5390 0754 7034 BIC") == "iban:3:22"
    assert spans("BE68539007547034 2024") == "iban:0:16"
    assert spans("BE68 5390 0754 7034 NO93 8601 1117 947") == "iban:0:19,iban:20:38"
    assert spans("AB12 CDEF GHIJ BE68 5390 0754 7034") == "iban:15:34"
    assert spans("BE69 5390 0754 7034 BIC") == ""


def test_taken_spans_are_those_of_a_plain_comparison():
    random.seed(9)
    for _ in range(300):
        base = [(a, a + random.randint(1, 30)) for a in random.sample(range(2000), random.randint(0, 40))]
        taken, used = pii._Taken(base), list(base)
        for _ in range(80):
            a = random.randrange(2000)
            b = a + random.choice([1, 5, 40, 700])
            free = not any(a < y and x < b for x, y in used)
            assert taken.take(a, b) == free
            if free:
                used.append((a, b))


def test_a_long_text_full_of_spans_is_linear():
    import time

    unit = "mail a.b@c.de ip 10.0.0.1 card 4111 1111 1111 1111 phone 555 123 4567 ssn 123-45-6789 DE89 3704 0044 0532 0130 00 +49 30 1234567. "
    began = time.process_time()
    got = pii.find(unit * 10_000)  # 1.3 MB
    assert got[:4] == (10_000,) * 4 and got[5].count("ssn:") == got[5].count("iban:") == 10_000
    for t in ("AB12 " * 100_000, "1-2 " * 100_000, "@a" * 200_000, "1." * 200_000, "(12)" * 100_000):
        pii.find(t)
    assert time.process_time() - began < 30
