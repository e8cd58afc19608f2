import math
import re
from collections import Counter

from pyspark.sql import functions as F

from rebasis.llm import licenses as c


def terms(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(rows, threshold=c.THRESHOLD):
    """(path, text) rows: own license and score, whether a license file, and the license after inheritance."""
    df = Counter(w for _, t in rows for w in set(terms(t)))

    def vector(ws):
        v = {w: k * (math.log((1.0 + len(rows)) / (1 + df[w])) + 1) for w, k in Counter(ws).items()}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}

    templates = [(name, vector(terms(t))) for name, t in c.TEMPLATES]
    own, files = {}, {}
    for path, text in rows:
        hits, covered = [], 0
        for line in (text or "").split("\n"):
            ws = terms(line)
            v = vector(ws) if ws else {}
            best = [(-round(s, 6), name) for name, t in templates if (s := sum(x * t.get(w, 0) for w, x in v.items())) >= threshold]
            if best:
                hits.append(min(best))
                covered += len(ws)
        if hits and path is not None:
            own[path] = (min(hits)[1], -min(hits)[0])
            if covered >= 0.5 * len(terms(text)):
                d = path.rpartition("/")[0]
                files[d] = min(files.get(d, (9, "", "")), (min(hits)[0], path, min(hits)[1]))
    out = []
    for path, _ in rows:
        if path in own:
            out.append((path, *own[path], own[path][0], None))
            continue
        d, found = (path or "").rpartition("/")[0], (None, None)
        while path is not None:
            if d in files:
                found = files[d][2], d
                break
            if not d:
                break
            d = d.rpartition("/")[0]
        out.append((path, None, None, *found))
    return sorted(out, key=str)


PROSE = "some code about parsing and the version of a work that all of us use under some terms"
ROWS = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0\n"), ("a/x.py", PROSE), ("a/b/y.py", PROSE + " more"),
    ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/z.py", "other words"),
    ("a/b/own.py", "# Released under the MIT License.\n" + PROSE + "\n" + PROSE), ("e/f.py", PROSE), ("g/h.py", None), ("g/i.py", ""),
    ("LICENSE", "All rights reserved."), (None, PROSE), ("a/two.py", "All rights reserved\n" + PROSE + "\nLicensed under CC BY-NC 4.0\n" + PROSE),
    ("root.py", "é ñ"), ("e/tie/A", "All rights reserved"), ("e/tie/B", "Released under the MIT License"), ("e/tie/q/r.py", "x"),
]


def run(spark, rows):
    df = spark.createDataFrame([(n, p, t, "z", 1) for n, (p, t) in enumerate(rows)],
                               "doc_id long, path0 string, text string, line string, term int").repartition(3)
    got = c.scan(df, F.col("path0")).collect()
    return sorted(((r.path, r.own_license, r.own_score, r.license, r.inherited_from) for r in got), key=str)


def test_scan(spark):
    want = brute(ROWS)
    assert run(spark, ROWS) == want
    assert {w[3] for w in want} >= {"Apache-2.0", "GPL-3.0", "MIT", "Proprietary", None}


def test_default_paths_and_edge_rows(frame, edge_rows):
    got = c.scan(frame(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    rows = {r.doc_id: r.path for r in got if r.doc_id is not None}
    assert rows[8] == "a/8.txt" and rows[10] == "c/1/10.txt" and rows[4] is None


def test_empty(frame):
    assert c.scan(frame([])).count() == 0
