import re

import pytest
from pyspark.sql import functions as F

from quizspark.llm import pii

TEXT = ("Mail Ann.Lee34@mail7.example.com or ann.lee34@MAIL7.example.com, call +1 (017) 555-7713 or +1 017 555 7713 (not 017-555-7713). "
        "Card 4845 1684-1144 0732 = 4845168411440732, host 97.51.17.173, ssn 123-45-6789. "
        "Mrs. Smith met Mr Smith, Frau Müller and Господин Иванов; Mrs Smith left.")


def _new(docs_of, rows):
    return {r.doc_id: r for r in pii.replace_pii(docs_of(rows), "k").collect()}


def test_types_formats_and_coreference(docs_of):
    got = _new(docs_of, [(1, TEXT), (2, "nothing here 12-34"), (3, "again ann.lee34@mail7.example.com, 97.51.17.173!")])
    t = got[1].text
    assert got[2].text == "nothing here 12-34" and got[2].pii_kinds == []
    for old in ("lee34", "555", "4845", "1144", "97.51", "123-45", "Smith", "Müller", "Иванов"):
        assert old not in t
    mails = re.findall(r"\S+@\S+\.example", t)
    assert len(set(m.strip(",") for m in mails)) == 1 and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d\d@[a-z]{4}\d\.[a-z]{7}\.example", mails[0].strip(","))
    a = re.search(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4}) \(not \d{3}-\d{3}-\d{4}\)", t)
    assert a and a.groups()[:3] == a.groups()[3:]
    c = re.search(r"Card (\d{4}) (\d{4})-(\d{4}) (\d{4}) = (\d{16})", t)
    assert c and "".join(c.groups()[:4]) == c.group(5)
    digits = [int(x) for x in c.group(5)]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(digits)) % 10 == 0
    ip = re.search(r"host (10\.\d+\.\d+\.\d+)", t).group(1)
    assert ip in got[3].text and mails[0].strip(",") in got[3].text
    names = re.search(r"Mrs\. (\w+) met Mr (\w+), Frau (\w+) and Господин (\w+); Mrs (\w+) left", t).groups()
    assert names[0] == names[4] != names[1]
    assert names[0].endswith("na") and names[1].endswith("n") and names[2].endswith("na") and re.fullmatch("[А-я]+н", names[3])
    assert got[1].pii_kinds.count("person") == 5 and got[1].pii_kinds.count("phone") == 3


def test_collisions_are_drawn_again(spark, monkeypatch):
    """A draw with few values: distinct entities stay distinct, none becomes a real one."""
    real = [("ip", f"10.0.0.{i}") for i in range(40)]
    monkeypatch.setattr(pii, "draw", lambda kind, canon, attempt, key: F.concat(
        F.lit("10.0.0."), (F.abs(F.hash(canon, attempt)) % 160).cast("string")))
    got = pii.surrogates(spark.createDataFrame(real, "kind string, canon string"), "k").collect()
    new = {r.canon: r.surrogate for r in got}
    assert len(new) == 40 and len(set(new.values())) == 40 and not set(new.values()) & set(new)
    monkeypatch.setattr(pii, "draw", lambda kind, canon, attempt, key: F.lit("same"))
    with pytest.raises(RuntimeError, match="39 entities"):
        pii.surrogates(spark.createDataFrame(real, "kind string, canon string"), "k", max_rounds=2)


def test_odd_rows(docs_of, odd, empty):
    out = pii.replace_pii(odd, "k")
    key = lambda rows: sorted(map(str, ((r.doc_id, r.text, r.lang) for r in rows)))
    assert key(out.collect()) == key(odd.collect()) and out.columns == odd.columns + ["pii_kinds"]
    assert pii.replace_pii(empty, "k").count() == 0
    twice = pii.replace_pii(docs_of([(1, "at 1.2.3.4"), (1, "at 1.2.3.4"), (None, "5.6.7.8 only"), (2, "x " * 500_000 + "9.9.9.9")]), "k").collect()
    assert len(twice) == 4 and len({r.text for r in twice if r.doc_id == 1}) == 1 and not any("9.9.9.9" in r.text for r in twice)
    with pytest.raises(ValueError):
        pii.replace_pii(odd, "")
    plan = pii.replace_pii(odd, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_more_entities_than_values_of_a_shape(spark, docs_of):
    """Over 12^4 one-word names, over 26^2 short e-mails, over half of all short
    telephone numbers: all settle, distinct and not real."""
    az = "abcdefghijklmnopqrstuvwxyz"
    rows = [("person", f"m X{i:05d}".translate(str.maketrans("0123456789", az[:10]))) for i in range(21_500)]
    rows += [("email", f"{a}@{b}.{c}") for a in az for b in az for c in ("de", "fr", "example")]
    rows += [("phone", f"+1{i:04d}") for i in range(6_000)] + [("ssn", f"{i:09d}") for i in range(50)]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    new = {(r.kind, r.canon): (r.kind, r.surrogate) for r in got}
    assert set(new) == set(rows) and len(set(new.values())) == len(rows) and not set(new.values()) & set(rows)
    for kind, form in (("person", r"m [A-Z][a-z]+n"), ("email", r"[a-z]+@[a-z]\.example"), ("phone", r"\+1\d{4,}"), ("ssn", r"\d{9}")):
        assert all(re.fullmatch(form, s) for k, s in new.values() if k == kind)


def test_draws_grow_and_are_written_whole(spark):
    at = spark.range(12).select(F.col("id").cast("int").alias("a"))
    def drawn(kind, canon):
        out = at.select("a", pii.draw(F.lit(kind), F.lit(canon), F.col("a"), "k").alias("s")).collect()
        return [r.s for r in sorted(out)]
    more = [max(0, a - pii.SHAPED + 1) for a in range(12)]
    assert [len(s) for s in drawn("person", "f Ann Lee")] == [3 + 2 * (8 + 2 * a + 2) for a in range(12)]
    assert [len(s) for s in drawn("email", "a@b.de")] == [11 + m for m in more]
    assert [len(s) for s in drawn("phone", "+12345")] == [6 + m for m in more] and [len(s) for s in drawn("ssn", "123456789")] == [9 + m for m in more]
    assert all(re.fullmatch("[а-я]+@[a-z].example", s) for s in drawn("email", "а@b.de"))
    firsts = [int(s.split(".")[0]) for s in drawn("ip", "1.2.3.4")]
    assert firsts[:4] == [10] * 4 and all(240 <= x < 256 for x in firsts[4:8]) and all(256 <= x < 1000 for x in firsts[8:])
    placed = spark.range(1).select(pii.formatted(F.lit("phone"), F.lit("+1 (23) 45"), F.lit("+1678901")).alias("s")).first().s
    assert placed == "+1 (67) 8901"


def test_whole_names_are_replaced(docs_of):
    names = ["Mr. John F. Kennedy", "Frau Anna Maria Schmidt", "Dr. Ludwig van der Berg", "Prof. Dr. J. R. R. Tolkien", "Herr Dr. Otto von Habsburg",
             "Mme Marie-Claire de la Tour", "Mr J.-P. O'Neil", "Ms Ann d'Artagnan", "Señor Juan Carlos García y Vega", "Mr X", "Dr Ada B Lovelace", "Frau Dr. Lise Meitner",
             "Господин Лев Николаевич Толстой"]
    got = _new(docs_of, [(i, f"then {n}, who left; {n} said so.") for i, n in enumerate(names)])
    for i, n in enumerate(names):
        title = re.match(r"(?:(?:Mr|Ms|Mme|Frau|Herr|Dr|Prof|Señor|Господин)\.? )+", n).group(0)
        m = re.fullmatch(rf"then {re.escape(title)}([\w ]+), who left; {re.escape(title)}([\w ]+) said so\.", got[i].text)
        assert m and m.group(1) == m.group(2) and got[i].pii_kinds == ["person"] * 2, got[i].text
        assert not set(re.findall(r"\w+", n[len(title):])) & set(re.findall(r"\w+", m.group(1)))
        assert all(w.endswith("na" if title.startswith(("Frau", "Mme", "Ms")) else ("н" if i == 12 else "n")) for w in m.group(1).split())
    dots = _new(docs_of, [(1, "Mr. John F. Kennedy"), (2, "Mr. John F Kennedy"), (3, "the Dr said no, Mr. and Mrs. too"), (4, "Mr " + "Aa " * 5_000),
                          (5, "Señor García y Señora López"), (6, "Frau Müller und Herr Schmidt"), (7, "Mr Lord")])
    assert dots[1].text == dots[2].text and dots[3].pii_kinds == [] and "Aa" not in dots[4].text.split()
    assert re.fullmatch(r"Señor \w+n y Señora \w+na", dots[5].text) and re.fullmatch(r"Frau \w+na und Herr \w+n", dots[6].text)
    assert "Lord" not in dots[7].text
