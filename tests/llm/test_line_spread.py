"""Boilerplate lines against a count of distinct sites in Python."""

import random

from logspark.llm import line_spread as L


def brute(rows, sites=L.MIN_SITES, words=L.MIN_WORDS):
    on = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            line = line.strip(L.SPACES)
            if len(line.replace("\t", " ").replace("\r", " ").split()) >= words and source is not None:
                on.setdefault(line, set()).add(source)
    bad = {line for line, s in on.items() if len(s) >= sites}
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if x.strip(L.SPACES) not in bad]
        new = "\n".join(kept)
        lost = len(text) - len(new)
        takes = 0 < lost <= L.MAX_SHARE * len(text)
        out.append((doc, new if takes else text, len(lines), len(lines) - len(kept) if takes else 0))
    return sorted(out, key=repr)


def rows_of_sites(seed=1):
    rng = random.Random(seed)
    common = [f"this line is everywhere {i}" for i in range(6)] + ["two words", "  padded line here \r"]
    rows = []
    for i in range(400):
        site = rng.choice([f"s{rng.randrange(9 + i % 4)}", "hot", None])
        lines = [f"own line {i} number {k} of many words" for k in range(rng.randint(0, 6))]
        for line in common:
            if rng.random() < 0.2:
                lines.insert(rng.randint(0, len(lines)), line)
        rows.append((i, "\n".join(lines), site))
    return rows


def digest(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_removed").collect()),
                  key=repr)


def test_against_brute_force(docs_of, odd_rows):
    rows = rows_of_sites() + [(*r[:2], r[2] if len(r) > 2 else "src0") for r in odd_rows]
    got = digest(L.remove_boilerplate(docs_of(rows)))
    assert got == brute(rows)
    assert sum(r[3] for r in got) > 100


def test_near_the_threshold(docs_of):
    """Lines on 8 to 12 sites: estimates alone may not decide."""
    rows = [(n * 100 + s, f"a line on {n} sites\nown text {n} {s} that is longer than the line", f"s{s}")
            for n in range(8, 13) for s in range(n)]
    assert digest(L.remove_boilerplate(docs_of(rows))) == brute(rows)


def test_copies_of_documents_stay(docs_of):
    text = "first line of a copy\nsecond line of a copy\nthird line of a copy"
    rows = [(i, text, f"s{i}") for i in range(30)]
    assert {r[1] for r in digest(L.remove_boilerplate(docs_of(rows)))} == {text}


def test_other_columns_stay(docs_of):
    docs = docs_of([(1, "a b c", "s")])
    out = L.remove_boilerplate(docs)
    assert set(out.columns) == {*docs.columns, "n_removed"}
    assert L.remove_boilerplate(docs.where("false")).collect() == []


def test_no_python_in_the_plan(docs_of):
    plan = L.remove_boilerplate(docs_of([(1, "a b c", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def mostly_boilerplate():
    """Ten sites with a long line each: short pages with a line of their own, and pages without one."""
    license = "this license line stands on all of the sites and is much longer than the rest"
    own = [(i, f"{license}\nown text {i}\n{license}\nhome", f"s{i}") for i in range(10)]
    return license, own, [(100 + i, f"{license}\nhome", f"s{i}") for i in range(10)]


def test_line_by_line(docs_of):
    _, own, bare = mostly_boilerplate()
    got = {r[0]: r[1:] for r in digest(L.remove_boilerplate(docs_of(own + bare), max_share=None))}
    assert all(got[i] == (f"own text {i}\nhome", 4, 2) for i, *_ in own)
    assert all(got[i] == (text, 2, 0) for i, text, _ in bare)


def test_line_by_line_against_brute_force(docs_of, odd_rows):
    rows = rows_of_sites() + [(*r[:2], r[2] if len(r) > 2 else "src0") for r in odd_rows]
    on = {}
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if len(line.split()) >= L.MIN_WORDS and source is not None:
                on.setdefault(line.strip(L.SPACES), set()).add(source)
    bad = {line for line, s in on.items() if len(s) >= L.MIN_SITES}
    expected, over_half = [], 0
    for doc, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(L.SPACES) not in bad]
        if any(len(x.split()) >= L.MIN_WORDS for x in kept) and len(kept) < len(lines):
            over_half += 2 * len("\n".join(kept)) < len(text)
            expected.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
        else:
            expected.append((doc, text, 0 if text is None else len(lines), 0))
    got = digest(L.remove_boilerplate(docs_of(rows), max_share=None))
    assert got == sorted(expected, key=repr) and over_half > 10


def test_long_lines_and_many_lines_are_harmless(docs_of):
    """A megabyte without spaces, and a document of 20,000 lines that stand on ten sites each."""
    long = "\n".join(f"line number {i} of many" for i in range(20_000))
    rows = [(i, long + "\nown words here " + str(i), f"s{i}") for i in range(10)]
    rows += [(20, "a" * 1_000_000, "s1"), (21, " " * 1_000_000 + "a", "s2"), (22, "a " + " " * 500_000, "s3")]
    got = {r["doc_id"]: r for r in L.remove_boilerplate(docs_of(rows), max_share=None).collect()}
    assert all(got[i]["text"] == f"own words here {i}" and got[i]["n_removed"] == 20_000 for i in range(10))
    assert all(got[i]["n_removed"] == 0 for i in (20, 21, 22))


def test_clashing_columns(docs_of):
    names = ("_line_drop", "_line_doc", "_line_kept", "_line_takes")
    docs = docs_of([(i, f"a line of all\nown {i} words", f"s{i}") for i in range(12)])
    for old, new in zip(("key", "batch", "n", "x"), names):
        docs = docs.withColumnRenamed(old, new)
    got = L.remove_boilerplate(docs).collect()
    assert len(got) == 12 and all(r[n] == "x" for r in got for n in names)
