import itertools
import random

from botsift.llm.cdc import boundaries, drop_repeats, repeated_spans
from botsift.llm.linededup import drop_fuzzy_lines, fuzzy_lines

from .test_neardup import components


def line_set(line):
    return {line[i:i + 5] for i in range(len(line))}


def brute_lines(rows):
    at = []
    for r in rows:
        for n, line in enumerate((r[1] or "").split("\n")):
            line = line.strip(" \t\v\f\r")
            if line:
                at.append((r[0], n, line))
    sets = {x[2]: line_set(x[2]) for x in at}
    names = {line: i for i, line in enumerate(sets)}
    links = [(names[a], names[b]) for (a, x), (b, y) in itertools.combinations(sets.items(), 2)
             if 100 * len(x & y) >= 80 * len(x | y)]
    comp = components(names.values(), links)
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    first = {}
    for x in sorted(at, key=order):
        first.setdefault(comp[names[x[2]]], order(x))
    return sorted(((x[0], x[1], order(x) == first[comp[names[x[2]]]]) for x in at), key=str), comp


def fuzzy_rows(seed=6):
    rng = random.Random(seed)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n))
    base = [line(40) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = [line(rng.randint(1, 12)) for _ in range(3)]
        b = base[i % 12]
        cut = rng.randint(0, len(b) - 1)
        lines += [base[(i + 1) % 12], b[:cut] + "X" + b[cut + 1:], "  " + base[0] + "\t", ""]
        rows.append((i, "\n".join(lines), "x"))
    return rows + [(50, None, "x"), (51, " \n\n", "x"), (None, base[1], "x"), (52, base[2], "x"), (52, base[2], "x"), (53, "x", "x"),
                   (54, "東京都の長い行です" * 5 + "\n" + "東京都の長い行です" * 5 + "が", "x"), (55, line(8000), "x")]


FUZZY = "doc_id bigint, text string, line string"


def test_lines_match_brute_force(spark):
    rows = fuzzy_rows()
    got = fuzzy_lines(spark.createDataFrame(rows, FUZZY)).collect()
    want, comp = brute_lines(rows)
    assert sorted(((r["doc_id"], r["line_no"], r["kept"]) for r in got), key=str) == want
    assert len({r["component_id"] for r in got}) == len(set(comp.values()))


def test_lines_on_corpus_and_empty(docs, rows, no_docs):
    got = fuzzy_lines(docs).collect()
    assert sorted(((r["doc_id"], r["line_no"], r["kept"]) for r in got), key=str) == brute_lines(rows)[0]
    assert fuzzy_lines(no_docs).count() == 0


def test_drop_lines(spark):
    d = spark.createDataFrame([(1, "a shared line of text\n\nown one", "x"), (2, "other\na shared line of text", "x"), (3, None, "x")], FUZZY)
    out = {r["doc_id"]: r["text"] for r in drop_fuzzy_lines(d).collect()}
    assert out == {1: "a shared line of text\n\nown one", 2: "other", 3: None}
    assert drop_fuzzy_lines(d).columns == d.columns


def test_drops_with_clashing_columns(spark):
    """Columns of the names that the operators use inside come through."""
    names = ["_lost", "_lines", "_cut", "_row", "lost", "lines", "cuts", "row", "n", "line"]
    schema = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names)
    passage = "a passage of many words that is long enough to be found twice, " * 4
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in
            ((1, "a shared line of text\nown one"), (2, "other\na shared line of text"), (3, None), (4, passage + "x"), (5, "y\n" + passage))]
    d = spark.createDataFrame(rows, schema)
    for out in (drop_fuzzy_lines(d), drop_repeats(d)):
        assert out.columns == d.columns
        got = {r["doc_id"]: tuple(r) for r in out.collect()}
        assert {k: v[2:] for k, v in got.items()} == {r[0]: r[2:] for r in rows}
    assert got[4][1] == rows[3][1] and len(got[5][1]) < 60 and got[3][1] is None


def test_boundaries_resist_shifts():
    rng = random.Random(7)
    data = bytes(rng.choice(b"abcdefghij ") for _ in range(20000))
    ends = boundaries(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = data[:777] + b"inserted" + data[777:]
    e2 = boundaries(moved)
    again = [moved[a:b] for a, b in zip([0, *e2], e2)]
    assert sum(c not in chunks for c in again) <= 8
    assert boundaries(b"") == [] and boundaries(b"x") == [1]
    assert max(b - a for a, b in zip([0, *boundaries(b"z" * 5000)], boundaries(b"z" * 5000))) <= 256


def brute_repeats(rows, n=100):
    """Byte positions of each document inside an n-byte string that another document has too."""
    data = {r[0]: (r[1] or "").encode() for r in rows}
    seen = {}
    for i, t in data.items():
        for p in range(len(t) - n + 1):
            seen.setdefault(t[p:p + n], set()).add(i)
    return {i: {q for p in range(len(t) - n + 1) if len(seen[t[p:p + n]]) > 1 for q in range(p, p + n)} for i, t in data.items()}


def test_spans_are_true_repeats_and_cover_passages(spark, rows):
    part = [r for r in rows if r[0] is not None and r[0] < 1000]
    d = spark.createDataFrame([(r[0], r[1], "x") for r in part], "doc_id bigint, text string, s string")
    got = repeated_spans(d).collect()
    truth = brute_repeats(part, 60)
    text = {r[0]: r[1].encode() for r in part}
    for r in got:
        covered = set(range(r["span_start"], r["span_end"]))
        assert len(covered & truth[r["doc_id"]]) >= 0.9 * len(covered)
        assert r["is_first"] == (r["doc_id"] == r["first_doc_id"])
    # the 70-word passage of documents 5..11, the copies 12..17, the near copies 18..25
    assert set(range(5, 26)) <= {r["doc_id"] for r in got}
    for i, t in text.items():
        if not brute_repeats(part, 30)[i]:
            assert i not in {r["doc_id"] for r in got}


def test_spans_edges(docs, no_docs, rows):
    assert repeated_spans(no_docs).count() == 0
    ids = {r["doc_id"] for r in repeated_spans(docs).collect()}
    assert None in ids  # a row without id repeats document 12
    out = drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[12] == rows[12][1] and len(kept[13]) < 0.2 * len(rows[13][1])
