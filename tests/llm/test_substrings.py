import random
from itertools import combinations

import numpy as np
from corpusql.llm.substrings import repeated_passages, winnow, without_repeats


def corpus(seed=6):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (51, 60, 140, 300)]
    short = text(20)  # too short to be a repeat
    docs = []
    for i in range(40):
        t, kind = text(r.randint(60, 400)), i % 4
        at = r.randint(0, len(t))
        if kind == 1:  # in the middle of a line
            t[at:at] = r.choice(passages)
        elif kind == 2:
            t[at:at] = short
        docs.append([kind, t])
    near = text(80)
    rows = [[i * 2 + 1, " ".join(t)] for i, (_, t) in enumerate(docs)]
    for i in (0, 4, 8):  # a paragraph alike in clean documents
        p = list(near)
        p[r.randrange(80)] = word()
        rows[i][1] += "\n" + " ".join(p) + "\nend"
    rows += [[100, rows[0][1]], [101, ""], [102, None], [103, "few words"], [104, " ".join(text(30))]]
    return [tuple(x) for x in rows]


def brute(rows):
    words = [(t or "").split() for _, t in rows]
    paragraphs = [[ln.split() for ln in (t or "").split("\n") if len(ln.split()) >= 25] for _, t in rows]
    runs = [{tuple(w[k : k + 50]) for k in range(len(w) - 49)} for w in words]
    sets = [[{tuple(p[k : k + 5]) for k in range(len(p) - 4)} for p in ps] for ps in paragraphs]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = set()
    for i, j in combinations(range(len(rows)), 2):
        if runs[i] & runs[j] or any(100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
            linked |= {i, j}
    return {rows[i][0]: (rows[find(i)][0], i in linked) for i in range(len(rows))}


def test_components_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in repeated_passages(docs).collect()}
    assert {d: (r.component_id, r.n_links + r.n_short_links > 0) for d, r in out.items()} == brute(rows)
    by = dict(rows)
    assert out[100].n_words == len(by[100].split()) and out[100].n_words - out[100].n_removed < 25 and 1 in out[100].sources
    assert out[1].n_removed == 0 and out[104].n_links == 0 and out[102].n_words == 0
    kept = {r.doc_id: r.text for r in without_repeats(docs, repeated_passages(docs)).collect()}
    assert all(len((kept[d] or "").split()) == out[d].n_words - out[d].n_removed for d in by)
    assert all(kept[d] == by[d] for d, r in out.items() if not r.n_removed)
    long = {1, 100} | {r.doc_id for r in out.values() if any(b - a >= 50 for a, b in zip(r.spans[::2], r.spans[1::2], strict=True))}
    assert long <= {d for d, r in out.items() if r.repeats}


def test_nulls_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(None, t), (1, t), (1, t), (2, "x")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_links) for r in repeated_passages(docs).collect()), key=str)
    assert out == [(1, 0), (1, 0), (2, 0), (None, 0)]
    clash = spark.createDataFrame([(1, t, "a", 1), (2, "y\n" + t, "b", 2), (3, "", "c", 3), (4, None, "d", 4)], "doc_id long, text string, spans_ string, ID_ long")
    got = without_repeats(clash, repeated_passages(clash))
    assert got.columns == clash.columns and sorted(map(tuple, got.collect())) == [(1, t, "a", 1), (2, "y\n ", "b", 2), (3, "", "c", 3), (4, None, "d", 4)]
    assert repeated_passages(docs.limit(0)).collect() == []


def test_winnowing_keeps_a_window_of_every_shared_run():
    r = np.random.default_rng(1)
    run = r.integers(0, 2**63, 26).astype(np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([r.integers(0, 2**63, int(r.integers(0, 90))).astype(np.uint64), run, r.integers(0, 2**63, int(r.integers(0, 90))).astype(np.uint64)]) for _ in range(2))
        assert {*a[winnow(a, 26)].tolist()} & {*b[winnow(b, 26)].tolist()} & {*run.tolist()}


def test_short_paragraphs_equal_brute_force_without_a_floor(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    line = lambda n: [word() for _ in range(n)]
    shared = {n: line(n) for n in (1, 4, 5, 8, 24)}
    near = line(24)
    wrapped = [line(12) for _ in range(8)]
    rows = [(1, " ".join(line(30)))]
    for n, w in shared.items():
        rows += [(10 * n + k, "\n".join([" ".join(line(30)), " ".join(w), " ".join(line(9))])) for k in (0, 1)]
    rows += [(300, " ".join(near)), (301, " ".join([*near[:-1], word()]) + "\n" + " ".join(line(7)))]  # 19 of 21 shingles
    for d in (400, 401):  # an edit in every other line: no run of 25 words is left
        rows.append((d, "\n".join(" ".join(w if k % 2 else [*w[:6], word(), *w[7:]]) for k, w in enumerate(wrapped))))
    sets = {d: [{tuple(p[k : k + 5]) for k in range(max(1, len(p) - 4))} for p in (x.split() for x in t.split("\n"))] for d, t in rows}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b])]
    out = {x.doc_id: x for x in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert pairs == [(10 * n, 10 * n + 1) for n in shared] + [(300, 301), (400, 401)]
    assert {d: x.component_id for d, x in out.items()} == {d: dict((b, a) for a, b in pairs).get(d, d) for d in out}
    assert {d for d, x in out.items() if x.n_short_links} == {d for p in pairs for d in p} and not any(x.repeats for x in out.values())
    for n in shared:
        assert (out[10 * n].n_removed, out[10 * n + 1].n_removed, list(out[10 * n + 1].spans)) == (0, n, [30, 30 + n])
    assert out[401].n_removed == 48


def test_the_whole_common_run_goes(spark):
    r = random.Random(12)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    rows, want = [], {}
    for k, n in enumerate((50, 51, 75, 76, 140)):
        run = text(n)
        for d in (10 * k, 10 * k + 1, 10 * k + 2):
            own = r.randint(20, 60)
            rows.append((d, " ".join([*text(own), *run, *text(30)])))
            want[d] = [own, own + n] if d % 10 else []
    run, more = text(60), text(15)  # the keeper has it twice; only its second place goes on
    rows += [(90, " ".join([*run, *text(20), *run, *more, *text(5)])), (91, " ".join([*text(7), *run, *more])), (92, " ".join(run).upper())]
    want |= {90: [], 91: [7, 82], 92: [0, 60]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x for x in repeated_passages(docs).collect()}
    assert {d: list(x.spans) for d, x in out.items()} == want
    assert all(x.n_removed == sum(want[d][1::2]) - sum(want[d][::2]) for d, x in out.items())
