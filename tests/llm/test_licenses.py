import math
import re
from collections import Counter

from corpusql.llm.licenses import COSINE, COVER, CUE, TEMPLATES, WORD, scan, template_rows


def files():
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.txt", "no word of it"), (3, "a/b/y.txt", "x\nLicensed under CC BY-NC 4.0.\nand some lines of prose after it"),
        (4, "a/b/c/z.txt", None), (5, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "q/r.txt", ""),
        (7, None, "Licensed under the Apache License, Version 2.0."), (8, "/abs/LICENSE.md", "Licensed under the GNU Lesser General Public License, version 3."), (9, "/abs/d/e.py", "pass"),
        (10, "q/s.txt", "his licence to kill was long and of no use to anybody in the whole wide world at all"), (11, "top.txt", "t"),
        (12, "a/two.txt", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0, with some other words.\n" + "prose " * 30), (1, "a/LICENSE", "Released under the MIT License."),
    ]
    return rows


def brute(rows):
    t = template_rows(TEMPLATES)
    vocabulary = {w for *_, ws in t for w in ws}
    lines = [(f, re.findall(WORD, ln.lower())) for f, _, x in rows for ln in (x or "").split("\n") if re.search(CUE, ln)]
    lines = [(f, len(w), Counter(x for x in w if x in vocabulary)) for f, w in lines if any(x in vocabulary for x in w)]
    df = Counter(w for *_, c in lines for w in c) + Counter(w for *_, ws in t for w in ws)
    idf = {w: math.log((len(lines) + len(t) + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    best = {}
    for f, n, c in lines:
        a = {w: k * idf[w] for w, k in c.items()}
        for _, name, ws in t:
            b = {w: k * idf[w] for w, k in ws.items()}
            cos = round(sum(a[w] * b.get(w, 0) for w in a) / math.hypot(*a.values()) / math.hypot(*b.values()), 6)
            if cos >= COSINE and sum(c.values()) >= COVER * n:
                best[f] = min(best.get(f, (0, "")), (-cos, name))
    return best


def test_headers_files_and_inheritance(spark):
    rows = files()
    out = {r.file: r for r in scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}
    assert len(out) == 12
    want = {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("CC-BY-NC-4.0", "header"), 4: ("GPL-3.0", "inherited"), 5: ("GPL-3.0", "file"), 6: (None, "none"), 7: ("Apache-2.0", "file"), 8: ("LGPL-3.0", "file"), 9: ("LGPL-3.0", "inherited"), 10: (None, "none"), 11: (None, "none"), 12: ("MIT", "header")}
    assert {f: (r.license, r.how) for f, r in out.items()} == want
    assert out[4].licence_dir == "a/b" and out[9].licence_dir == "/abs" and out[2].licence_dir == "a"
    for f, (cos, name) in brute(rows).items():
        assert out[f].license == name and abs(out[f].cosine + cos) < 2e-6


def test_every_template_finds_itself(spark):
    rows = [(k, f"d{k}/x", t) for k, (name, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]
    names = [n for n, ts in TEMPLATES.items() for _ in ts]
    out = {r.file: r for r in scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}
    assert all(out[k].license in (names[k], None) for k, *_ in rows)
    assert sum(out[k].license is not None for k, *_ in rows) >= len(rows) - 2


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "file long, path string, text string")).collect() == []


def test_wrapped_notices_and_whole_licence_files(spark):
    mit = "MIT\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at https://mozilla.org/MPL/2.0/.\n#\nimport os\n"
    cc = "a note\n---\nThis work is made available under a Creative\nCommons Attribution-ShareAlike 4.0 International\nLicense.\n\n" + "prose of some length " * 20
    rows = [(1, "m/LICENSE", mit), (2, "m/a.py", "pass"), (3, "p/x.py", mpl), (4, "c/y.txt", cc), (5, "n/LICENSE", "nothing of the kind"), (6, "n/z.py", "pass"), (7, "e/LICENSE", None)]
    out = {r.file: (r.license, r.how) for r in scan(spark.createDataFrame(rows, "file long, path string, text string")).collect()}
    assert out == {1: ("MIT", "file"), 2: ("MIT", "inherited"), 3: ("MPL-2.0", "header"), 4: ("CC-BY-SA-4.0", "header"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none")}


def test_every_template_is_found_as_its_own(spark):
    rows = [(k, f"d{k}/x", t, n) for k, (n, t) in enumerate((n, t) for n, ts in TEMPLATES.items() for t in ts)]
    wrapped = [(100 + k, f"w{k}/x", "\n".join(" ".join(t.split()[i : i + 6]) for i in range(0, len(t.split()), 6)), n) for k, _, t, n in rows]
    out = {r.file: r.license for r in scan(spark.createDataFrame([x[:3] for x in rows + wrapped], "file long, path string, text string")).collect()}
    assert out == {k: n for k, _, _, n in rows + wrapped}


def test_rows_of_one_id_and_of_none_are_files_of_their_own(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(5, "x/a.txt", mit), (5, "x/b.txt", apache), (None, "x/c.txt", mit), (None, "x/d.txt", "plain"), (5, "x/a.txt", mit)]
    out = sorted((str(r.file), r.path, str(r.license)) for r in scan(spark.createDataFrame([(*r, 1, 2) for r in rows], "file long, path string, text string, row int, dir int")).collect())
    known = {"x/a.txt": "MIT", "x/b.txt": "Apache-2.0", "x/c.txt": "MIT"}
    assert [(f, p) for f, p, _ in out] == sorted((str(f), p) for f, p, _ in rows) and all(known.get(p, lic) == lic for _, p, lic in out)
