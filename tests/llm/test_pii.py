import hashlib
import re

import pytest

from mergeloom.llm import pii

R = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = []
    for k, (name, p) in enumerate(R.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if good:
                out.append((m.start(), k, m.end(), name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out)), [sum(o[1] == k for o in out) for k in range(4)]


TEXTS = [
    None, "", "a@b.com_x@c.org x@y.z.com. a@b@c.com", "1.2.3.4.5.6.7.8 256.1.1.1 000.001.2.03 1.2.3.4567", "4111 1111 1111 1111 4111-1111-1111-1111-1 4111111111111111  4111111111111111 5 - 4111 1111 1111 1111",
    "+1 (068) 555-2748+1 234 567 8901 +12", "é@b.co ñ😀 x@😀.com 😀a@b.co +49 (0)30 1234567", "9" * 5000, "a.b" * 3000 + "@x" + ".y" * 6000, "1 " * 4000, "1.2.3.4" * 500, "x@y.com," * 300, "+" * 300 + "1",
    "Dr. James Smith, phone (068) 555-2748, joe [at] example [dot] com, 12345678901234567",
]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    import mergeloom.llm.pii as m

    folder = str(tmp_path_factory.mktemp("pii"))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, spans string")
    df.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return m.op2_personal_data(spark, folder).collect()


def test_base_is_brute_force(results):
    assert len(results) == 2 * len(TEXTS)
    for r in results:
        want, counts = base(TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_method_adds(results):
    assert next(r.spans for r in results if r.doc_id == 13).split(",") == ["name:0:15", "phone:23:37", "email:39:65"]


def test_tables(spark, docs, odd, empty):
    for r in pii.personal_data(docs).select("doc_id", pii.joined(pii.F.col("base")).alias("b")).join(docs, "doc_id").collect():
        assert r.b == base(r.text)[0]
    assert pii.personal_data(empty).count() == 0 and pii.personal_data(odd).count() == odd.count()


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "write x@y.com or 4111 1111 1111 1111.", 37), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("write [EMAIL] or [CARD].", 24), 2: (None, None), 3: ("clean", 5)}
    assert pii.redact(odd).columns == odd.columns
    plan = pii.redact(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_em_learns_reliabilities():
    import numpy as np

    kind, vote = np.zeros(2, int), np.array([[1, 1, 0, 1, 0], [-1, -1, 0, -1, -1]])
    post, rel = pii.expectation_maximisation(kind, vote, np.array([100.0, 100.0]))
    assert post[0] > 0.99 and post[1] < 0.01 and rel[0, 0, 1, 2] > 0.9
