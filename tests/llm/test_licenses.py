import os
import re
import textwrap

import pytest

from quizspark.llm import licenses as lic


def _ids(df):
    return {(r.doc_id, r.unit): r.license_id for r in df.collect()}


def test_spelling_case_and_copyright_lines(docs_of):
    mit = dict(lic.KNOWN)["ISC"]
    mine = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SOFTWARE", "Software").replace(".", " ; ").replace("license", "licence")
    got = _ids(lic.license_scan(docs_of([
        (1, mine), (2, mit + " And more."), (3, "A poem.\nreleased under the MIT Licence\nEnd"),
        (4, "Copyright 2001 X\nAll rights reserved.\n" + lic._MIT), (5, "© 2020 y\n" + lic._ZLIB.replace("acknowledgment", "acknowledgement"))])))
    assert got[1, -1] == "ISC" and got[2, -1] is None and got[3, -1] is None and got[3, 1] == "MIT"
    assert got[4, -1] == "MIT" and got[5, -1] == "Zlib"
    assert len(got) == 6


def test_known_texts_find_themselves_and_lists_can_differ(spark, docs_of):
    got = _ids(lic.license_scan(docs_of([(i, t.replace("\n", " ")) for i, (_, t) in enumerate(lic.KNOWN)])))
    assert all(got[i, -1] == n for i, (n, _) in enumerate(lic.KNOWN))
    own = lic.license_scan(docs_of([(1, "Do as you like."), (2, "x\nDO AS YOU LIKE\ny")]), [("OWN", "do as you like")])
    assert _ids(own) == {(1, -1): "OWN", (1, 0): "OWN", (2, -1): None, (2, 1): "OWN"}


def test_odd_rows(odd, empty):
    got = lic.license_scan(odd).collect()
    assert len(got) == 8 and {r.license_id for r in got} == {None}
    assert {r.digest is None for r in got if r.doc_id == 1} == {True}
    assert lic.license_scan(empty).count() == 0


def test_no_python(odd):
    assert "Python" not in lic.license_scan(odd)._jdf.queryExecution().executedPlan().toString()


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isfile(f"{COMMON}/GPL-3"), reason="no full licence texts here")
def test_full_texts_in_any_wrapping(docs_of):
    files = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows, want = [], {}
    for name, license_id in files.items():
        with open(f"{COMMON}/{name}") as f:
            text = f.read()
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text) if p.strip()]
        wrapped = "\n\n".join(textwrap.fill(p, 57) for p in paragraphs)
        forms = [text, wrapped, "\n".join("# " + x for x in wrapped.splitlines()).upper(), "\n".join(paragraphs), " ".join(paragraphs)]
        if "END OF TERMS" in text:
            forms.append(text[:text.index("END OF TERMS")])
        for form in forms:
            want[len(rows), -1] = license_id
            rows.append((len(rows), form))
        want[len(rows), -1] = None
        rows.append((len(rows), text.replace("distribut", "sell")))       # not the text any more
    got = _ids(lic.license_scan(docs_of(rows)))
    assert {k: got[k] for k in want} == want


def test_full_texts_only_with_the_own_list(spark):
    assert lic.known_digests(spark, [("OWN", "do as you like")]).count() == 1
    digests = [x for d in lic.DIGESTS.values() for x in d]
    assert all(re.fullmatch("[0-9a-f]{64}", x) for x in digests) and len(set(digests)) == len(digests)
